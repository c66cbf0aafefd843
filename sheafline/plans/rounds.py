"""Bounded loops over DataFrames."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tables import settled

#: Rounds until introspection has to be stable.
FIXPOINT_ROUNDS = 5
LOOP_ROUNDS = 10_000


def digest(df: DataFrame) -> tuple[int, int]:
    """Row count and an order-independent hash."""
    cols = [F.to_json(F.struct(F.col(c))) if t.startswith("map") else F.col(c) for c, t in df.dtypes]
    n, h = df.agg(F.count("*"), F.sum(F.xxhash64(*cols).cast("decimal(38,0)"))).first()
    return n, int(h or 0)


def fixpoint(start: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int = FIXPOINT_ROUNDS) -> tuple[DataFrame, bool]:
    """step() applied until the rows stay the same, and whether they did within the rounds."""
    now = settled(start)
    seen = digest(now)
    for _ in range(rounds):
        now = settled(step(now))
        after = digest(now)
        if after == seen:
            return now, True
        seen = after
    warnings.warn(f"no fixed point after {rounds} rounds", stacklevel=2)
    return now, False


def while_(start: DataFrame, condition: Callable[[DataFrame], bool], body: Callable[[DataFrame], DataFrame], most: int = LOOP_ROUNDS) -> DataFrame:
    """body() while the condition holds; endless loops are an error."""
    now, n = start, 0
    while condition(now):
        n += 1
        if n > most:
            raise RuntimeError(f"the condition still holds after {most} rounds")
        now = settled(body(now))
    return now
