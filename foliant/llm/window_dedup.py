"""Substring dedup on word windows behind a count-min prefilter.

1. Every task sketches the anchors of its windows (see anchors.py) and the sketches are merged. Counts are never too
   low, so no repeated window is lost.
2. Anchors that may be repeated become rows with a hash of the whole stretch of their windows. Rows with equal stretches
   are grouped: in all but the first, every window occurred before.
3. Where anchors with one gram have different stretches, the windows of each stretch's first row are grouped one by one.
4. Runs of windows that occurred before are joined to the texts and their words removed.

Words are compared by 64-bit and stretches by 128-bit hashes: two of 10**9 different words share one with a probability of 3 %,
two of 10**12 stretches with one below 10**-14.

Defined results: null and empty texts have no words; texts shorter than a window keep all words; rows with one
doc_id stand level, none before the other; a null doc_id stands before all others; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.anchors import Anchors, broadcast_sketch, find_anchors, maybe_repeated, names_of
from foliant.llm.arrow import result, slices
from foliant.llm.common import batch_words, discard, gram_hashes, mix, stored

WINDOW, GRAM = 20, 8
#: The facts of a key with more than one row in so many are broadcast.
HEAVY = 1000
NULL_ID = -(1 << 63)


def keyed(docs: DataFrame) -> DataFrame:
    """id (null: the smallest long), th (hash of the text) and text: a document's key across all passes."""
    return docs.select("doc_id", F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), F.xxhash64("text").alias("th"), "text")


def matched(rows: DataFrame, facts: DataFrame, key: list[str], total: int) -> DataFrame:
    """``rows`` with the other columns of ``facts``, which has one row for a key and its number of rows as ``__n``; null without one.

    The facts of keys with more than one in HEAVY of the ``total`` rows, fewer than HEAVY of them, are broadcast, and those rows are
    dealt out by themselves in the join with the other facts, so that no key's rows meet in one task.
    """
    names, heavy = [c for c in facts.columns if c not in (*key, "__n")], F.col("__n") * HEAVY > total
    hot = facts.filter(heavy).select(*key, F.lit(True).alias("__is_hot"), *[F.col(c).alias(f"__hot_{c}") for c in names])
    rest = facts.filter(~heavy).select(*[F.col(c).alias(f"__key_{c}") for c in key], *[F.col(c).alias(f"__own_{c}") for c in names])
    tagged = rows.join(F.broadcast(hot), key, "left").withColumn("__to", F.when(F.col("__is_hot"), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.col(key[0])))
    on = F.col("__is_hot").isNull() & (F.col("__to") == F.col(f"__key_{key[0]}"))
    for c in key[1:]:
        on = on & (F.col(c) == F.col(f"__key_{c}"))
    both = tagged.join(rest, on, "left")
    return both.select(*rows.columns, *[F.coalesce(f"__hot_{c}", f"__own_{c}").alias(c) for c in names])


def earliest(rows: DataFrame, key: list[str], start: str) -> DataFrame:
    """A stored table: ``rows``, a stored table that this one takes the place of, with ``first``, the (id, start) that comes
    first among the rows with one key; aggregated before it is joined back.
    """
    total, own = rows.count(), F.struct("id", F.col(start).alias("start"))
    firsts = stored(rows.groupBy(*key).agg(F.min(own).alias("first"), F.count("*").alias("__n")).filter("__n > 1"))
    out = stored(matched(rows, firsts, key, total).withColumn("first", F.coalesce("first", own)))
    discard(rows, firsts)
    return out


def is_later(start: str) -> Column:
    return (F.col("id") > F.col("first.id")) | ((F.col("id") == F.col("first.id")) & (F.col(start) > F.col("first.start")))


def per_document(rows: DataFrame, *columns: str) -> DataFrame:
    """(id, th) -> items: a document's own stretches, each once however often the row is repeated; never more than it has words."""
    return rows.groupBy("id", "th").agg(F.collect_set(F.struct(*columns)).alias("items"))


def unsettled(anchors: DataFrame, same: list[str]) -> DataFrame:
    """Of the first rows of each stretch (columns ``same``), those whose gram occurs with other stretches too."""
    mixed = F.lit(False)
    for c in same:
        mixed = mixed | (F.min(c) != F.max(c))
    firsts = anchors.filter(~is_later("lo"))
    spread = stored(firsts.groupBy("gram").agg(F.count("*").alias("__n"), mixed.alias("mixed")).filter("mixed"))
    return matched(firsts, spread, ["gram"], firsts.count()).filter("mixed")


def covered(n: int, items: list, extra: int) -> np.ndarray:
    """Which of n entries lie in one of the stretches (first window, number of windows)."""
    hit = np.zeros(n + 1, np.int64)
    if items:
        lo = np.array([i["lo"] for i in items])
        hi = lo + np.array([i["n"] for i in items]) - 1 + extra
        np.add.at(hit, lo, 1)
        np.add.at(hit, hi, -1)
    return np.cumsum(hit)[:n] > 0


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(id, th, lo, n): stretches of windows that all start earlier somewhere."""
    texts = keyed(docs)

    def anchors(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, Anchors]:
        words = batch_words(b["text"])
        token = words.tokens()
        return token, words.starts, find_anchors(mix(gram_hashes(token, gram), 7), words.starts, window, gram)

    shared = broadcast_sketch(docs, lambda batches: (anchors(b)[2].gram for b in slices(batches, "text")), 32)

    def rows(batches):
        for b in slices(batches, "text"):
            token, starts, a = anchors(b)
            a = a.picked(maybe_repeated(shared.value, a.gram))
            c1, c2 = names_of(token.tobytes(), 8 * a.first, 8 * (a.last + window))
            text = pa.array(a.text)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a.gram.view(np.int64)), pa.array(c1 + (a.at - a.first)), pa.array(c2), b["id"].take(text), b["th"].take(text),
                 pa.array((a.first - starts[a.text]).astype(np.int32)), pa.array((a.last - a.first + 1).astype(np.int32))],
                names=["gram", "c1", "c2", "id", "th", "lo", "n"])

    found = stored(texts.select("id", "th", "text").mapInArrow(rows, "gram long, c1 long, c2 long, id long, th long, lo int, n int"))
    found = earliest(found, ["c1", "c2"], "lo")
    later = found.filter(is_later("lo")).select("id", "th", "lo", "n")
    open_rows = per_document(unsettled(found, ["c1", "c2"]), "lo", "n")

    def windows(batches):
        for b in slices(batches, "text"):
            words = batch_words(b["text"])
            starts, items = words.starts, b["items"].to_pylist()
            at = [starts[k] + np.concatenate([np.arange(i["lo"], i["lo"] + i["n"]) for i in own]) for k, own in enumerate(items)]
            at = np.unique(np.concatenate(at)) if at else np.zeros(0, np.int64)
            text = np.searchsorted(starts, at, side="right") - 1
            w1, w2 = names_of(words.tokens().tobytes(), 8 * at, 8 * (at + window))
            yield pa.RecordBatch.from_arrays([pa.array(w1), pa.array(w2), b["id"].take(pa.array(text)), b["th"].take(pa.array(text)), pa.array((at - starts[text]).astype(np.int32))], names=["w1", "w2", "id", "th", "lo"])

    # repeated rows have one key: one of them is enough to look into
    single = texts.select("id", "th", "text").join(open_rows, ["id", "th"])
    one_by_one = stored(single.mapInArrow(windows, "w1 long, w2 long, id long, th long, lo int"))
    one_by_one = earliest(one_by_one, ["w1", "w2"], "lo").filter(is_later("lo")).select("id", "th", "lo", F.lit(1).alias("n"))
    return later.unionByName(one_by_one)


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 (and the text that is left, if asked for)."""
    runs = per_document(repeated_windows(docs, window, gram), "lo", "n")
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    schema = pa.schema(fields + [("kept_text", pa.string())] * with_text)

    def remove(batches):
        for b in slices(batches, "text"):
            out = []
            for text, items in zip(b["text"].to_pylist(), b["items"].to_pylist()):
                words = text.encode().split() if text else []
                gone = covered(len(words), items, window) if items else None
                left = b" ".join(words if gone is None else [w for w, g in zip(words, gone) if not g])
                row = (len(words), 0 if gone is None else int(gone.sum()), hashlib.sha256(left).hexdigest())
                out.append((*row, left.decode()) if with_text else row)
            yield result(schema, b["doc_id"], *zip(*out)) if out else pa.RecordBatch.from_pylist([], schema=schema)

    sql = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return keyed(docs).join(runs, ["id", "th"], "left").select("doc_id", "text", "items").mapInArrow(remove, sql)
