"""Near strings by deletion neighbourhoods: no string is compared with all others.

Two strings within d edits of each other become equal when d characters or fewer
are deleted from each. So each side lists what its strings become by that, both
lists are joined on hashes, and the pairs that meet are verified by their distance.
The work grows with the strings and with what is near, not with their product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def deletions(text: Column, most: int) -> Column:
    """Hashes of all strings that deleting up to `most` characters gives, each once."""
    one = lambda s: F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))),
        lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))),
    )
    level = every = F.array(text)
    for _ in range(most):
        level = F.array_distinct(F.flatten(F.transform(level, one)))
        every = F.concat(every, level)
    return F.array_distinct(F.transform(every, lambda s: F.xxhash64(s)))


def near(left: DataFrame, right: DataFrame, left_col: str, right_col: str, most: int) -> DataFrame:
    """(left_col, right_col, distance): distinct strings of both sides within `most` edits, 3 or so; nulls are near nothing."""
    if most < 0:
        raise ValueError("a distance below 0")
    a = left.select(F.col(left_col).alias("_a")).where("_a IS NOT NULL").distinct().select("_a", F.explode(deletions(F.col("_a"), most)).alias("_h"))
    b = right.select(F.col(right_col).alias("_b")).where("_b IS NOT NULL").distinct().select("_b", F.explode(deletions(F.col("_b"), most)).alias("_h"))
    met = a.join(b, "_h").select("_a", "_b").distinct()
    return met.withColumn("distance", F.levenshtein("_a", "_b", most)).where("distance >= 0").withColumnsRenamed({"_a": left_col, "_b": right_col})
