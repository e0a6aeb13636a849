"""Sharding: the smallest shard capacity over an ordered run of atomic groups.

All copies of one text form a group that no cut may divide. Groups are ordered
by the SHA-256 of their text; a shard is a contiguous run of that order. The
smallest capacity with which a greedy walk needs no more than the wanted number
of shards is found by bisection, and the walk at that capacity gives the cuts.

The walk runs on sums by key prefix. It starts with at most 65,537 prefixes of
four hex digits whatever the input's size, and only the prefixes that a walk
would cut through are refined, two digits at a time, down to single groups. So
the result is exact and the driver never sees more than those sums.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

#: Row numbers within a shard are dealt over so many windows.
SALTS = 4096
#: Capacities that one round of the bisection tries.
TRIES = 15


class _Walk:
    """Sums of group sizes by prefix of the group's key, refined on demand."""

    def __init__(self, groups: DataFrame, shards: int):
        self.groups, self.shards = groups, shards
        rows = self._sums(F.substring("_key", 1, 4), groups)
        self._set(rows)

    @staticmethod
    def _sums(prefix, groups):
        got = groups.groupBy(prefix.alias("p")).agg(F.sum("_bytes").alias("b"), F.count(F.lit(1)).alias("n"))
        return [(r["p"], int(r["b"]), int(r["n"])) for r in got.collect()]

    def _set(self, rows) -> None:
        self.rows = sorted(rows)
        self.sums = np.cumsum([0] + [r[1] for r in self.rows])

    def cuts(self, capacity: int) -> tuple[list[int], set[int], bool]:
        """First node of each shard, nodes that must be refined first, whether all fits."""
        at, cuts, coarse, last = 0, [], set(), len(self.rows)
        for _ in range(self.shards):
            cuts.append(at)
            at = int(np.searchsorted(self.sums, self.sums[at] + capacity, side="right")) - 1
            if at < last and self.rows[at][2] > 1:
                coarse.add(at)
        return cuts, coarse, at >= last

    def refine(self, nodes: set[int]) -> None:
        split = [self.rows[i][0] for i in sorted(nodes)]
        keep = [r for i, r in enumerate(self.rows) if i not in nodes]
        for size in sorted({len(p) for p in split}):
            some = self.groups.where(F.substring("_key", 1, size).isin([p for p in split if len(p) == size]))
            keep += self._sums(F.substring("_key", 1, size + 2), some)
        self._set(keep)

    def exact(self, capacities: list[int]) -> list[bool]:
        while True:
            found = [self.cuts(c) for c in capacities]
            coarse = set().union(*(f[1] for f in found))
            if not coarse:
                return [f[2] for f in found]
            self.refine(coarse)

    def smallest(self) -> list[str]:
        """Keys at which shards after the first begin, at the smallest feasible capacity."""
        if not self.rows:
            return []
        total = int(self.sums[-1])
        low, high = math.ceil(total / self.shards) - 1, total  # low is infeasible, high is feasible
        if self.exact([low + 1])[0]:
            high = low + 1
        step = max(1, total // (64 * self.shards))
        while high - low > 1:
            tries = sorted({min(high - 1, low + step * 2**i) for i in range(TRIES)} if high == total else {low + (high - low) * i // (TRIES + 1) for i in range(1, TRIES + 1)} - {low})
            for c, fits in zip(tries, self.exact(tries), strict=True):
                if fits:
                    high = c
                    break
                low = max(low, c)
        return [self.rows[i][0] if i < len(self.rows) else "~" for i in self.cuts(high)[0][1:]]


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", set_apart: bool = False) -> DataFrame:
    """Put every row into one of `shards` shards of near-equal bytes.

    Returns id_col, size (UTF-8 bytes of the text plus 1), text_crc32, shard and
    slot, a gapless row number from 0 within the shard. Rows with equal texts
    share a shard. A null text counts one byte and forms one group with the
    other null texts; its text_crc32 is null. An empty text is a group of its
    own. Repeated rows each get a slot; rows that tie in id and text are alike in all that is
    returned but the slot. Very long texts are one size among others. An empty table gives no rows; other
    columns of docs are ignored, whatever their names.

    The shards are one contiguous partition of all groups, with the smallest capacity that is feasible. A group that
    is larger than an equal share sets this capacity, and the greedy walk then fills some shards and leaves others
    empty. With set_apart such a group gets a shard to itself, and the rest are cut over the others.
    """
    rows = materialise(
        docs.select(
            F.col(id_col).alias("_id"),
            F.coalesce(F.sha2(F.col(text_col).cast("binary"), 256), F.lit("null")).alias("_key"),
            (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.col(text_col).cast("binary")).alias("text_crc32"),
        ),
        "shard-rows",
    )
    groups = materialise(rows.groupBy("_key").agg(F.sum("size").alias("_bytes")), "shard-groups")
    total = groups.agg(F.sum("_bytes")).first()[0] or 0
    alone = []
    for key, size in groups.orderBy(F.desc("_bytes"), "_key").limit(shards if set_apart else 0).collect():
        if len(alone) + 1 < shards and size * (shards - len(alone)) > total:
            alone.append(key)
            total -= size
    rest = groups.where(~F.col("_key").isin(alone)) if alone else groups
    bounds = _Walk(rest, shards - len(alone)).smallest()
    where = F.lit(len(alone))
    for b in bounds:
        where = where + (F.col("_key") >= b).cast("int")
    for i, key in enumerate(alone):
        where = F.when(F.col("_key") == key, i).otherwise(where)
    dealt = rows.withColumn("shard", where.cast("int")).withColumn("_salt", F.pmod(F.xxhash64("_id", "_key"), F.lit(SALTS)).cast("int"))
    before = Window.partitionBy("shard").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "_salt").count().select("shard", "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    slot = F.row_number().over(Window.partitionBy("shard", "_salt").orderBy("_id", "_key")) - 1
    # At most shards * SALTS rows, whatever the input.
    return (
        dealt.withColumn("slot", slot)
        .join(F.broadcast(starts), ["shard", "_salt"])
        .select(F.col("_id").alias(id_col), "size", "text_crc32", "shard", (F.col("slot") + F.col("_start")).cast("long").alias("slot"))
    )
