"""Mixing sources to target weights by systematic sampling.

Sources share the sum of all sizes by weight, none above three times its own
size; what the cap cuts off is shared again by weight. Within a source each
document is expected `target / source size` times. The expected copies are
summed up in order of size, one random offset is added, and a document is
emitted once for each integer that its interval crosses. The order by size makes
the sample even over sizes, so that the words taken come near the target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialise, ranked

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: No source, and so no document, is taken more often than this.
MOST = 3


def _level(sources: DataFrame, total: int) -> float:
    """Words per unit of weight at which the uncapped sources use up the total."""
    level, capped = 0.0, -1
    while True:
        full = F.col("source_size") * MOST < F.lit(level) * F.col("weight") if capped >= 0 else F.lit(False)
        now, fixed, free = sources.agg(
            F.count(F.when(full, 1)), F.sum(F.when(full, F.col("source_size") * MOST)), F.sum(F.when(~full, F.col("weight")))
        ).first()
        if now == capped or not free:
            return level if capped >= 0 else 0.0
        capped, level = now, (total - (fixed or 0)) / free


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", key_col: str | None = None) -> DataFrame:
    """How often the mix takes each document.

    Returns id_col (and key_col, where rows have a key that tells those of one id apart), source, size (words of the text), source_size, target (words
    that the source should give), copies and taken = copies * size. A null text
    has size 0; an empty source gets target 0 and no copies; rows without a
    source form one source, which comes last. Ties in size go by id, then by key; repeated
    rows are documents of their own. Very long texts are counted whole. An empty table gives no rows, and other
    columns of docs, whatever their names, are ignored. Reruns give the same rows.
    """
    rows = materialise(
        docs.select(
            F.col(source_col).cast("string").alias("source"),
            F.col(id_col).alias("_id"),
            (F.col(key_col) if key_col else F.lit(0)).alias("_key"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        ),
        "mix-rows",
    )
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    sources = ranked(sums, ["source"], "nr", "mix-sources")
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("nr") - 1) % len(weights) + 1).cast("int"))
    sources = materialise(sources.withColumn("weight", pick), "mix-weights")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = _level(sources, total)
    target = F.least(F.col("source_size") * float(MOST), F.lit(level) * F.col("weight"))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    shares = sources.withColumn("target", target).withColumn("offset", offset)
    # The order starts with the source, so a source's first row number gives the ranks within it.
    order = ranked(rows, ["source", "size", "_id", "_key"], "nr", "mix-order")
    least = order.groupBy("source").agg((F.min("nr") - 1).alias("before"))
    plan = materialise(shares.drop("nr").alias("a").join(least.alias("b"), F.expr("a.source <=> b.source")).select("a.*", "b.before"), "mix-plan")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    at = F.col("d.nr") - F.col("p.before")
    copies = F.floor(F.col("offset") + rate * at) - F.floor(F.col("offset") + rate * (at - 1))
    # One row per source: Spark broadcasts it if its measured size allows, else it shuffles and splits skew.
    return (
        order.alias("d")
        .join(plan.alias("p"), F.expr("d.source <=> p.source"))
        .select(F.col("d._id").alias(id_col), *([F.col("d._key").alias(key_col)] if key_col else []), F.col("d.source").alias("source"), F.col("d.size").alias("size"), "source_size", "target", copies.cast("long").alias("copies"))
        .withColumn("taken", F.col("copies") * F.col("size"))
    )


ORACLE = f"""
WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '{WORD}')) END AS size FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([5, 2, 1])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
o AS (SELECT *, ((SELECT sum(source_size) FROM s) - coalesce(sum(3 * source_size) OVER (ORDER BY source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
l AS (SELECT max(level) AS level FROM o),
t AS (SELECT o.source, source_size, least(3 * source_size, l.level * weight) AS target,
  ('0x' || substr(md5('7:' || coalesce(o.source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM o, l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
  row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) AS k FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target, ((floor(u + rate * k) - floor(u + rate * (k - 1))) * size)::BIGINT AS taken FROM r
"""
