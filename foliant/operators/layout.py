"""From words and fragments with positions to lines of text."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators.grouped import map_groups

#: How far a word may lie from the first of its line; confidence of text that was no image.
LINE_GAP, NATIVE_CONFIDENCE = 4.0, 0.98
#: Fragments up to which a page is worked on as plain numbers.
SMALL_PAGE = 64


def box_of_all() -> list[Column]:
    """Aggregates for the smallest box around all boxes of a group."""
    return [F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom")]


def box_measures() -> dict[str, Column]:
    """Width and height of x0, top, x1, bottom, 0 at least, and the box to two decimals as a list."""
    sides = [F.col(c).cast("double") for c in ("x0", "top", "x1", "bottom")]
    x0, top, x1, bottom = sides
    return {"width": F.greatest(F.lit(0.0), x1 - x0), "height": F.greatest(F.lit(0.0), bottom - top), "box": F.array(*[F.round(s, 2) for s in sides])}


def line_numbers(top: np.ndarray, gap: float) -> np.ndarray:
    """The line, from 1, of each word of a page in their order from the top: one that lies more than ``gap`` off the first word of the line begins a new one."""
    out, anchor, n = [], None, 0
    for t in top.tolist():
        if anchor is None or abs(t - anchor) > gap:
            anchor, n = t, n + 1
        out.append(n)
    return np.array(out, np.int32)


def numbered_words(words: DataFrame, gap: float = LINE_GAP) -> DataFrame:
    """The words (doc_id, page_number, text, x0, top, x1, bottom) with line_no. Words are taken from the top, then from the left; a null place is 0, a null text empty. A page is one group."""
    sides = ("x0", "top", "x1", "bottom")

    def run(pages: pa.Table, starts: np.ndarray) -> pa.Table:
        top = pages["top"].to_numpy()
        found = [line_numbers(top[a:z], gap) for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(top)])]
        return pages.append_column("line_no", pa.array(np.concatenate(found), pa.int32()))

    rows = words.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("page_number").cast("int").alias("page_number"), F.coalesce("text", F.lit("")).alias("text"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in sides])
    return map_groups(rows, ["doc_id", "page_number"], ["top", "x0", "x1", "bottom", "text"], run, "doc_id long, page_number int, text string, x0 double, top double, x1 double, bottom double, line_no int")


def word_lines(words: DataFrame, gap: float = LINE_GAP) -> DataFrame:
    """(doc_id, page_number, line_no, text, x0, top, x1, bottom, confidence): the words of each line (see numbered_words) from the left."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "top", "text"))), lambda w: w["text"]), " ")
    return numbered_words(words, gap).groupBy("doc_id", "page_number", "line_no").agg(text.alias("text"), *box_of_all()).withColumn("confidence", F.lit(NATIVE_CONFIDENCE))


def native_blocks(words: DataFrame, page_lines: DataFrame, gap: float = LINE_GAP) -> DataFrame:
    """``word_lines``, and for pages without words their text lines (doc_id, page_number, line_no, text), which have no box."""
    found = word_lines(words, gap)
    rest = page_lines.filter(F.trim("text") != "").join(words.select("doc_id", "page_number").distinct(), ["doc_id", "page_number"], "left_anti")
    none = [F.lit(None).cast("double").alias(c) for c in ("x0", "top", "x1", "bottom")]
    return found.unionByName(rest.select("doc_id", F.col("page_number").cast("int").alias("page_number"), F.col("line_no").cast("int").alias("line_no"), F.trim("text").alias("text"), *none, F.lit(NATIVE_CONFIDENCE).alias("confidence")))


def token_lines(tokens: DataFrame) -> DataFrame:
    """Lines of recognised tokens, which know their block and line: from the top, then from the left; confidence is the mean.

    ``tokens``: doc_id, page_number, block, line, text, x0, top, x1, bottom, confidence.
    """
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"]), " ")
    return tokens.groupBy("doc_id", "page_number", "block", "line").agg(text.alias("text"), *box_of_all(), F.avg("confidence").alias("confidence"))


def upper_median(values: str) -> Column:
    """Of an even number of values the upper one in the middle."""
    held = F.array_sort(F.collect_list(values))
    return F.element_at(held, (F.floor(F.size(held) / 2) + 1).cast("int"))


def ocr_quality(confidence: Column, text: Column) -> Column:
    """How good recognised text looks: its confidence, the share of letters and digits, and how much there is of it."""
    all_, solid = F.length(F.regexp_replace(text, r"\s", "")), F.length(F.regexp_replace(text, r"(?U)[^\p{L}\p{N}]", ""))
    return 0.55 * confidence + 0.25 * F.coalesce(solid / F.nullif(all_, F.lit(0)), F.lit(0.0)) + 0.20 * F.least(F.lit(1.0), solid / 30)


def cluster_lines(top: np.ndarray, bottom: np.ndarray, x0: np.ndarray, tolerance: float | None = None) -> np.ndarray:
    """The line of each fragment of a page.

    From the top down, a fragment joins the line with the nearest centre (the mean of its fragments') among those that it overlaps by .35
    of the lower of both heights or whose centre is within the tolerance, .45 of the upper median height and 2 at least.
    """
    height, centre = np.maximum(1.0, bottom - top), (top + bottom) / 2
    near = max(2.0, float(np.sort(height)[len(height) // 2]) * 0.45) if tolerance is None else tolerance
    if len(top) <= SMALL_PAGE:
        return _few_lines(top, bottom, x0, height, centre, near)
    line = np.empty(len(top), np.int64)
    low, high, total, n = (np.empty(len(top)) for _ in range(4))
    used = 0
    for k in np.lexsort((x0, top)):
        off = np.abs(total[:used] / n[:used] - centre[k])
        shared = np.maximum(0.0, np.minimum(high[:used], bottom[k]) - np.maximum(low[:used], top[k]))
        fits = (shared / np.maximum(1.0, np.minimum(high[:used] - low[:used], height[k])) >= 0.35) | (off <= near)
        if fits.any():
            at = int(np.argmin(np.where(fits, off, np.inf)))
            low[at], high[at] = min(low[at], top[k]), max(high[at], bottom[k])
            total[at] += centre[k]
            n[at] += 1
        else:
            at, used = used, used + 1
            low[at], high[at], total[at], n[at] = top[k], bottom[k], centre[k], 1
        line[k] = at
    return line


def _few_lines(top: np.ndarray, bottom: np.ndarray, x0: np.ndarray, height: np.ndarray, centre: np.ndarray, near: float) -> np.ndarray:
    """The same lines on plain numbers, which are quicker than arrays of a few of them."""
    line, lines = [0] * len(top), []  # a line: its top, bottom, sum of centres, fragments
    t, b, h, c = top.tolist(), bottom.tolist(), height.tolist(), centre.tolist()
    for k in np.lexsort((x0, top)).tolist():
        best, at = math.inf, None
        for j, (low, high, total, n) in enumerate(lines):
            off = abs(total / n - c[k])
            if off < best and (off <= near or max(0.0, min(high, b[k]) - max(low, t[k])) / max(1.0, min(high - low, h[k])) >= 0.35):
                best, at = off, j
        if at is None:
            line[k] = len(lines)
            lines.append((t[k], b[k], c[k], 1))
        else:
            low, high, total, n = lines[at]
            lines[at] = (min(low, t[k]), max(high, b[k]), total + c[k], n + 1)
            line[k] = at
    return np.array(line, np.int64)


def visual_lines(fragments: DataFrame, tolerance: float | None = None) -> DataFrame:
    """(doc_id, page_number, line_no, text): fragments of a page in lines whose centres move with what joins them; one group is a page.

    Fragments on one place are taken by their lower edge, then by their text; a null text is empty, a null place is 0.
    """

    def run(pages: pa.Table, starts: np.ndarray) -> pa.Table:
        top, bottom, x0 = (pages[c].to_numpy() for c in ("top", "bottom", "x0"))
        line = np.concatenate([cluster_lines(top[a:z], bottom[a:z], x0[a:z], tolerance) for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(top)])])
        page = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(top)))
        order = np.lexsort((np.arange(len(x0)), x0, line, page))
        begins = np.flatnonzero((np.diff(line[order], prepend=-1) != 0) | (np.diff(page[order], prepend=-1) != 0))
        text = pages["text"].take(pa.array(order)).to_pylist()
        rows = [" ".join(text[a:z]) for a, z in zip(begins.tolist(), [*begins[1:].tolist(), len(text)])]
        first = pa.array(starts[page[order][begins]])
        return pa.table({"doc_id": pages["doc_id"].take(first), "page_number": pages["page_number"].take(first), "line_no": pa.array(line[order][begins] + 1, pa.int32()), "text": pa.array(rows, pa.string())})

    place = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    rows = fragments.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("page_number").cast("int").alias("page_number"), F.coalesce("text", F.lit("")).alias("text"), place("top"), place("bottom"), place("x0"))
    return map_groups(rows, ["doc_id", "page_number"], ["top", "x0", "bottom", "text"], run, "doc_id long, page_number int, line_no int, text string")
