"""Headers that are nearly alike, without comparing all pairs.

The ratio of two names is at most twice the letters they share (as multisets) over the sum of their lengths. Where the mean over c columns is to be t, two columns at least must have a ratio of
s = (c t - 1) / (c - 1) or more, since all others but one below s leave the sum below c t. So one such column is among any c - 1 of them, and the column with the fewest names need not be looked at.
Where s is small, it is taken instead that one column at least has the mean, t.
Names of a column that may reach s meet by their rarest letters: of a name of length n, all but n s / (2 - s) - 1 of them (prefix filtering).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators.tables import header_ratio
from foliant.sources.kept import kept


def letters(name: Column) -> Column:
    """The letters of a name with how often each came so far, so that the sets' intersection is that of the multisets: ``aba`` gives a1, b1, a2."""
    each = F.filter(F.split(name, ""), lambda x: x != "")
    return F.transform(each, lambda x, k: F.concat(x, F.size(F.filter(F.slice(each, 1, k + 1), lambda y: y == x)).cast("string")))


def bound(left: Column, right: Column) -> Column:
    """The most that the ratio of two names can be; of their letters."""
    total = F.size(left) + F.size(right)
    return F.when(total == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(left, right)) / total)


def names_in_reach(names: DataFrame, least: Column) -> DataFrame:
    """(n, col, name, other): names of one column whose ratio may be ``least`` or more, each way and each with itself. ``names``: n (columns), col, name, each once."""
    rows = names.withColumn("letters", letters(F.col("name"))).withColumn("s", least)
    each = rows.select("n", "col", "name", "letters", "s", F.explode_outer("letters").alias("letter"))
    seen = each.groupBy("n", "col", "letter").agg(F.count("*").alias("seen")).withColumnRenamed("letter", "l").withColumnsRenamed({"n": "n2", "col": "col2"})
    rare = Window.partitionBy("n", "col", "name").orderBy("seen", "letter")
    ranked = each.join(seen, (F.col("n") == F.col("n2")) & (F.col("col") == F.col("col2")) & F.col("letter").eqNullSafe(F.col("l"))).withColumn("place", F.row_number().over(rare))
    size = F.size("letters")
    first = ranked.filter(F.col("place") <= size - F.ceil(size * F.col("s") / (2 - F.col("s")) - 1e-9) + 1)
    own = first.select("n", "col", "letter", "name", "letters", "s")
    other = own.select(F.col("n").alias("n2"), F.col("col").alias("col2"), F.col("letter").alias("l"), F.col("name").alias("other"), F.col("letters").alias("other_letters"))
    met = own.join(other, (F.col("n") == F.col("n2")) & (F.col("col") == F.col("col2")) & F.col("letter").eqNullSafe(F.col("l")))
    near = met.filter((F.col("name") == F.col("other")) | (bound(F.col("letters"), F.col("other_letters")) >= F.col("s") - 1e-9))
    return near.select("n", "col", "name", "other").distinct()


def header_candidates(headers: DataFrame, least: float) -> DataFrame:
    """(left, right), left < right: distinct headers (``k``, arrays of keys) of one length whose mean ratio may be ``least`` or more."""
    rows = kept(headers.select("k", F.size("k").alias("n")).filter("n > 0").distinct())
    cells = rows.select("k", "n", F.posexplode("k").alias("col", "name"))
    names = kept(cells.select("n", "col", "name").distinct())
    n = F.col("n")
    second = F.when(n > 1, (n * least - 1) / (n - 1)).otherwise(0.0)
    two = second >= least / 2  # else one column with the mean at least says more than two with so little
    s = F.when(two, second).otherwise(least)
    counted = names.groupBy("n", "col").agg(F.count("*").alias("names"))
    place = F.row_number().over(Window.partitionBy("n").orderBy("names", "col"))
    looked = counted.withColumn("place", place).filter((F.col("place") > 1) | ~two).select(F.col("n").alias("n3"), F.col("col").alias("col3"))
    reach = names_in_reach(names, s).join(looked, (F.col("n") == F.col("n3")) & (F.col("col") == F.col("col3"))).drop("n3", "col3")
    left = cells.join(reach, ["n", "col", "name"]).select("n", "col", F.col("other").alias("name"), F.col("k").alias("left"))
    pairs = left.join(cells.withColumnRenamed("k", "right"), ["n", "col", "name"]).filter("left < right").select("left", "right").distinct()
    sums = F.aggregate(F.zip_with("left", "right", lambda a, b: bound(letters(a), letters(b))), F.lit(0.0), lambda s, x: s + x)
    return pairs.filter(sums >= F.size("left") * least - 1e-9)


def similar_headers(headers: DataFrame, least: float = 0.8) -> DataFrame:
    """(left, right, ratio): all pairs of distinct headers with a mean ratio of ``least`` or more. ``headers``: k, an array of header keys (see header_key)."""
    return header_candidates(headers, least).withColumn("ratio", header_ratio("left", "right")).filter(F.col("ratio") >= least)
