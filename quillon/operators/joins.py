"""Joins on named keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOW = {"inner": "inner", "left": "left", "right": "right", "outer": "full", "full": "full", "semi": "left_semi", "anti": "left_anti"}
#: Hints by strategy; auto leaves the choice to Spark, which broadcasts only what its size allows.
STRATEGY = {"auto": None, "broadcast": "broadcast", "sort_merge": "merge", "hash_partition": "shuffle_hash", "nested_loop": "shuffle_replicate_nl"}


def join(left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "inner", strategy: str = "auto", suffix: str = "_right") -> DataFrame:
    """Equi-join: the right keys go, and right columns whose names clash get a suffix."""
    keys = [on] if isinstance(on, str) else list(on)
    if how not in HOW:
        raise ValueError(f"unknown join {how!r}")
    if strategy not in STRATEGY:
        raise ValueError(f"unknown strategy {strategy!r}")
    taken = set(left.columns)
    clash = [c for c in right.columns if c in taken and c not in keys]
    if clash and HOW[how] not in ("left_semi", "left_anti"):
        right = right.withColumnsRenamed({c: c + suffix for c in clash})
    if STRATEGY[strategy]:
        right = right.hint(STRATEGY[strategy])
    return left.join(right, keys, HOW[how])


def cross(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.crossJoin(right)


def theta(left: DataFrame, right: DataFrame, condition: Column, how: str = "inner") -> DataFrame:
    """A join on any condition; an equality in it is what makes it distribute."""
    return left.join(right, condition, HOW[how])


def merge(left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "inner", validate: str | None = None, strategy: str = "auto") -> DataFrame:
    """join() that can check its keys first: one_to_one, one_to_many, many_to_one, many_to_many."""
    keys = [on] if isinstance(on, str) else list(on)
    sides = {None: (), "many_to_many": (), "one_to_one": ("left", "right"), "one_to_many": ("left",), "many_to_one": ("right",)}
    if validate not in sides:
        raise ValueError(f"unknown validation {validate!r}")
    for side in sides[validate]:
        repeated = (left if side == "left" else right).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").limit(1)
        if repeated.count():
            raise ValueError(f"keys {keys} repeat on the {side}")
    return join(left, right, keys, how, strategy)
