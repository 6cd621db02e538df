"""MinHash near-dedup with circulant permutations.

A shingle's hash passes a first permutation of the 32-bit integers; coordinate k of the signature is the least value
of a second one, the same for all k, after a circular shift by k steps (C-MinHash, Li and Li, 2021). BANDS bands of ROWS coordinates
give candidates: a pair at the similarity 0.85 shares no band with probability (1 - 0.85**4)**28 < 2e-9, one at 0.80 < 5e-7.

Documents with equal shingle sets (by a 128-bit hash of the sorted 64-bit hashes: two different sets among 10**9 meet with a
probability below 10**-9, given that no shingles do) are one class. In each bucket the classes are compared with one hub, the class with most
bucket neighbours, on their full shingle sets. Where a bucket still holds several components, classes are compared across
components by the shingles in which they differ from the hub: few, and a link between classes of which one isn't linked with
the hub needs a good part of them in common. Pairs meet under their rarest differences only, and no link is lost.

Defined results: null and empty texts have no shingles and are linked with nothing, not even each other; a text of fewer
words than a shingle is one shingle; repeated rows each get their row, in one component; a null id is the
smallest long inside and null in the result; rows that share an id (null too) are told apart by their texts; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm import tokens
from foliant.llm.arrow import result, slices
from foliant.llm.common import WORD, batch_words, gram_hashes, mix, stored
from foliant.llm.components import components
from foliant.llm.window_dedup import NULL_ID, keyed

SHINGLE, BANDS, ROWS = 5, 28, 4
STEP = 0x9E3779B9
#: The two permutations.
FIRST, SECOND = (0x7FEB352D, 0x846CA68B), (0x21F0AAAD, 0xD35A2D97)
#: Links have 100 * intersection >= percent * union, by default this one.
PERCENT = 85


def shingle_words(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case; other letters stay."""
    return text.encode().lower().split() if text else []


def shingles(text: str | None, n: int = SHINGLE) -> set[bytes]:
    words = shingle_words(text)
    if len(words) < n:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[k : k + n]) for k in range(len(words) - n + 1)}


def permuted(x: np.ndarray, odd: tuple[int, int]) -> np.ndarray:
    """A permutation of the 32-bit integers, another one for each pair of odd factors."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(odd[0])
    x = (x ^ (x >> np.uint32(15))) * np.uint32(odd[1])
    return x ^ (x >> np.uint32(16))


def signature(first: np.ndarray, cuts: np.ndarray, n: int) -> np.ndarray:
    """(texts, n) least values; ``first`` has the first permutation's values, text t's from cuts[t] on."""
    out = np.empty((len(cuts), n), np.uint32)
    for k in range(n):
        out[:, k] = np.minimum.reduceat(permuted(first + np.uint32(k * STEP & 0xFFFFFFFF), SECOND), cuts)
    return out


def hashed_sets(texts: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of all texts in a row, sorted in each, and each text's number of them."""
    words = batch_words(texts, lower=True)
    token, starts = words.tokens(), words.starts
    grams = {k: mix(gram_hashes(token, k), k) for k in range(1, n + 1)}
    sets = []
    for a, b in zip(starts[:-1], starts[1:]):
        k = min(n, b - a)
        sets.append(np.unique(grams[k][a : b - k + 1]) if k else token[:0])
    return np.concatenate(sets) if sets else token[:0], np.array([len(s) for s in sets], np.int64)


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, id, th (hash of the text), n_shingles, set_hash (of the sorted set, null if empty) and the hash of each band."""
    schema = pa.schema([("doc_id", pa.int64()), ("id", pa.int64()), ("th", pa.int64()), ("n_shingles", pa.int64()), ("set_hash", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        tokens.forget()  # a worker that lives on holds the vocabulary and pieces of an operator before this one
        for b in slices(batches, "text"):
            flat, n = hashed_sets(b["text"])
            ends = np.cumsum(n)
            full = np.flatnonzero(n)
            bands: list = [None] * len(n)
            keys: list = [None] * len(n)
            if len(full):
                first = permuted((flat ^ (flat >> np.uint64(32))).astype(np.uint32), FIRST)
                s = signature(first, (ends - n)[full], BANDS * ROWS).reshape(len(full), BANDS, ROWS).astype(np.uint64)
                h = np.zeros(s.shape[:2], np.uint64)
                for r in range(ROWS):
                    h = mix(h ^ s[:, :, r], r + 1)
                for k, row in zip(full, h.view(np.int64)):
                    bands[k] = row
                    keys[k] = hashlib.blake2b(flat[ends[k] - n[k] : ends[k]].tobytes(), digest_size=16).digest()
            yield result(schema, b["doc_id"], b["id"], b["th"], n, keys, bands)

    return keyed(docs).mapInArrow(run, "doc_id long, id long, th long, n_shingles long, set_hash binary, bands array<long>")


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, text_a, text_b) for pairs (a, b) of classes."""
    with_b = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    with_a = with_b.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    return with_a.select("a", "b", "text_a", "text_b")


def compared(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes with the number of shingles they share, and whether that makes a link; ``texts`` has id and text.

    A pair goes to the text of its second class, then to that of the first; each task holds two sets at a time.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("both", pa.int64()), ("linked", pa.bool_())])

    def confirm(batches):
        tokens.forget()
        held, own = None, set()
        for b in slices(batches, "text_b"):
            out = []
            for x, y, left, right in zip(*(b[c].to_pylist() for c in ("a", "b", "text_a", "text_b"))):
                if held != x:
                    held, own = x, shingles(left)
                other = shingles(right)
                both = len(own & other)
                out.append((x, y, both, 100 * both >= percent * (len(own) + len(other) - both)))
            yield result(schema, *zip(*out)) if out else pa.RecordBatch.from_pylist([], schema=schema)

    return with_texts(pairs, texts).mapInArrow(confirm, "a long, b long, both long, linked boolean")


def shingle_rows(texts: DataFrame) -> DataFrame:
    """(id, shingle) with 64-bit hashes, one row per distinct shingle of a text."""

    def run(batches):
        for b in slices(batches, "text"):
            flat, n = hashed_sets(b["text"])
            yield pa.RecordBatch.from_arrays([b["id"].take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(flat.view(np.int64))], names=["id", "shingle"])

    return texts.select("id", "text").mapInArrow(run, "id long, shingle long")


def differences(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, differing) for pairs of classes: the hashes of the shingles that one of the two has and the other has not."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("differing", pa.list_(pa.int64()))])

    def sets_of(text: pa.Array) -> list[np.ndarray]:
        flat, n = hashed_sets(text)
        return np.split(flat, np.cumsum(n)[:-1])

    def run(batches):
        tokens.forget()
        for b in slices(batches, "text_b"):
            left = b["text_a"].dictionary_encode()
            hubs, others = sets_of(left.dictionary), sets_of(b["text_b"])
            yield result(schema, b["a"], b["b"], [np.setxor1d(hubs[k], o, assume_unique=True).view(np.int64) for k, o in zip(left.indices.to_pylist(), others)])

    return with_texts(pairs, texts).mapInArrow(run, "a long, b long, differing array<long>")


def differing_alike(around: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes around one hub, of which at least one isn't in the hub's component, that could still be linked.

    ``around``: hub, hub_size, id, n_shingles, component, out (not in the hub's component), most (shingles that another open class has), both (those the hub has).
    With d for the number of shingles in which a class differs from the hub and o for those in which two classes differ from it alike,
    x and y are linked if d(x) + d(y) - 2 o <= (100 - percent) / (100 + percent) * (n(x) + n(y)). So o has a least value for each class,
    a higher one against a class that isn't linked with the hub, and two classes differ alike in one of the first d - o + 1 of their
    differences at least, in any one order; here those come first in which few classes differ.
    """
    above, below = 100 + percent, 100 - percent
    d = F.col("n_shingles") + F.col("hub_size") - 2 * F.col("both")
    least = lambda numerator, by: F.greatest(F.lit(1), F.ceil(numerator / by))
    rows = around.withColumn("d", d).withColumn("need", least(F.col("d") * percent - F.col("n_shingles") * below, percent))
    rows = rows.withColumn("need_out", F.greatest("need", least(F.col("d") * above + (F.col("hub_size") - F.col("n_shingles")) * below + 1, 2 * above)))
    alike = F.col("most") - F.col("both") + F.col("hub_size") - F.col("both")
    rows = stored(rows.withColumn("out", F.col("out") & (alike >= F.col("need"))).withColumn("other", alike >= F.col("need_out")).filter("out OR other"))
    apart = differences(rows.select(F.col("hub").alias("a"), F.col("id").alias("b")), texts).select(F.col("a").alias("hub"), F.col("b").alias("id"), F.explode("differing").alias("shingle"))
    apart = stored(apart)
    often = apart.groupBy("hub", "shingle").agg(F.count("*").alias("n")).filter("n > 1")
    ordered = apart.join(often, ["hub", "shingle"]).groupBy("hub", "id").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("differing"))
    ordered = stored(rows.join(ordered, ["hub", "id"]).withColumn("size", F.size("differing")))

    def first(side: str, need: str, prefix: str = "") -> DataFrame:
        mine = ordered.filter(f"{side} AND size >= {need}").withColumn("key", F.explode(F.expr(f"slice(differing, 1, CAST(size - {need} + 1 AS INT))")))
        return mine.select("hub", F.col("key.shingle").alias("shingle"), *[F.col(c).alias(prefix + c) for c in ("id", "component", "n_shingles", "d", "size")])

    alike = F.least("size", "o_size")
    possible = 2 * above * alike >= above * (F.col("d") + F.col("o_d")) - below * (F.col("n_shingles") + F.col("o_n_shingles"))
    met = first("out", "need").join(first("other", "need_out", "o_"), ["hub", "shingle"]).filter((F.col("component") != F.col("o_component")) & possible)
    met = stored(met.select("hub", F.col("id").alias("x"), F.col("o_id").alias("y"), F.col("d").alias("x_d"), F.col("o_d").alias("y_d"), F.col("n_shingles").alias("x_n"), F.col("o_n_shingles").alias("y_n")).distinct())
    # how many differences they really have in common
    sets = ordered.select("hub", "id", F.col("differing.shingle").alias("s"))
    both = met.join(sets.withColumnsRenamed({"id": "x", "s": "x_s"}), ["hub", "x"]).join(sets.withColumnsRenamed({"id": "y", "s": "y_s"}), ["hub", "y"])
    both = both.filter(2 * above * F.size(F.array_intersect("x_s", "y_s")) >= above * (F.col("x_d") + F.col("y_d")) - below * (F.col("x_n") + F.col("y_n")))
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def class_links(classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """(id, component) of classes that are linked with others. ``classes``: id (a number of its own), rep (id and th of its text), n_shingles, bands."""
    keys = classes.select("id", F.posexplode("bands").alias("band", "key"))
    sizes = keys.groupBy("band", "key").agg(F.count("*").alias("size")).filter("size > 1")
    members = stored(keys.join(sizes, ["band", "key"]))
    # a class near the middle of a group of near copies shares most buckets with the others
    degree = members.groupBy("id").agg(F.sum("size").alias("degree"))
    ranked = stored(members.select("id", "band", "key").join(degree, "id"))
    hubs = ranked.groupBy("band", "key").agg(F.max_by("id", F.struct("degree", -F.col("id"))).alias("hub"))
    buckets = stored(ranked.join(hubs, ["band", "key"]).select("id", "band", "key", "hub"))
    candidates = buckets.select("id").distinct()
    wanted = classes.join(candidates, "id").select(F.col("id").alias("class"), F.col("rep.id").alias("id"), F.col("rep.th").alias("th"))
    texts = keyed(docs).join(wanted, ["id", "th"]).select(F.col("class").alias("id"), "text")
    texts = stored(texts.dropDuplicates(["id"]))
    star = buckets.filter("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    tested = stored(compared(star, texts, percent))
    edges = tested.filter("linked").select("a", "b")
    first = components(edges)
    # buckets that still hold more than one component
    named = buckets.join(first, "id", "left").withColumn("component", F.coalesce("component", "id"))
    spread = named.groupBy("band", "key").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least <> most").select("band", "key")
    still = stored(named.join(spread, ["band", "key"]))
    # what a class can share at most: shingles that some other open class has too
    open_ids = still.select("id").distinct()
    open_texts = texts.join(open_ids, "id", "left_semi")
    shared = shingle_rows(open_texts).groupBy("shingle").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    total = classes.select("id", "n_shingles").join(open_ids, "id", "left_semi")
    alone = shared.filter("n = 1").groupBy("id").agg(F.count("*").alias("own"))
    bound = total.join(alone, "id", "left").withColumn("most", F.col("n_shingles") - F.coalesce("own", F.lit(0)))
    alive = bound.filter(F.col("most") * 100 >= F.col("n_shingles") * percent).select("id", "n_shingles", "most")
    to_hub = tested.select(F.col("a").alias("hub"), F.col("b").alias("id"), "both")
    hub_of = still.filter("id = hub").select("hub", F.col("component").alias("hub_component")).distinct()
    hub_size = total.select(F.col("id").alias("hub"), F.col("n_shingles").alias("hub_size"))
    around = still.filter("id <> hub").select("hub", "id", "component").distinct()
    around = around.join(alive, "id").join(to_hub, ["hub", "id"]).join(hub_of.join(hub_size, "hub"), "hub").withColumn("out", F.col("component") != F.col("hub_component"))
    across = differing_alike(around, texts, percent)
    done = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = stored(compared(across.join(done, ["a", "b"], "left_anti"), texts, percent).filter("linked").select("a", "b"))
    if rest.isEmpty():
        return first
    return components(edges.unionByName(rest))


def near_classes(docs: DataFrame, described: DataFrame, percent: int) -> DataFrame:
    """set_hash, component and ``least``: the (id, th) that comes first in the component; one row per class, stored."""
    firsts = described.filter("set_hash IS NOT NULL").groupBy("set_hash").agg(F.min(F.struct("id", "th")).alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    firsts = stored(firsts.withColumn("id", F.monotonically_increasing_id()))
    linked = class_links(firsts.drop("set_hash"), docs, percent)
    named = stored(firsts.join(linked, "id", "left").select("set_hash", "rep", F.coalesce("component", "id").alias("component")))
    return stored(named.join(named.groupBy("component").agg(F.min("rep").alias("least")), "component").select("set_hash", "component", "least"))


def near_copies(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (least doc_id it is linked with, over any number of links), kept."""
    described = stored(describe(docs))
    named = near_classes(docs, described, percent).select("set_hash", F.col("least.id").alias("component"))
    rows = described.select("doc_id", "id", "n_shingles", "set_hash").join(named, "set_hash", "left")
    component = F.coalesce("component", "id")
    return rows.select("doc_id", "n_shingles", F.nullif(component, F.lit(NULL_ID)).alias("component_id"), (F.col("id") == component).alias("kept"))


def drop_near_copies(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents that stay, with all their columns: one of each group, the first by id and text, and all without words.

    Of repeated rows (one id, one text) with words one stays.
    """
    stay = near_classes(docs, stored(describe(docs)), percent).select(F.col("least.id").alias("__id"), F.col("least.th").alias("__th")).distinct()
    own = [F.col(f"`{c}`").alias(f"x{k}") for k, c in enumerate(docs.columns)]  # whatever their names, they clash with none here
    rows = docs.select(F.struct(*own).alias("__row"), F.coalesce("doc_id", F.lit(NULL_ID)).alias("__id"), F.xxhash64("text").alias("__th"), F.coalesce(F.col("text").rlike(WORD), F.lit(False)).alias("__words"))
    one = rows.filter("__words").join(stay, ["__id", "__th"], "left_semi").groupBy("__id", "__th").agg(F.first("__row").alias("__row"))
    out = one.select("__row").unionByName(rows.filter("NOT __words").select("__row"))
    return out.select(*[F.col(f"__row.x{k}").alias(c) for k, c in enumerate(docs.columns)])
