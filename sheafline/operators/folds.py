"""Running state and hierarchical counters over ordered rows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counter_steps(steps: DataFrame, levels: int, group: list[str], ord: str = "ord", level: str = "level", out: str = "counter") -> DataFrame:
    """steps with the hierarchical counter after each: a step of level k counts up at k and ends what is below.

    Windows only: what stands at level k is the number of steps of level k
    since the last one above it.
    """
    over = lambda *extra: Window.partitionBy(*group, *extra).orderBy(ord).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = steps.withColumns({f"__reset{k}": F.coalesce(F.sum(F.when(F.col(level) < k, 1)).over(over()), F.lit(0)) for k in range(1, levels + 1)})
    counts = [F.sum(F.when(F.col(level) == k, 1).otherwise(0)).over(over(f"__reset{k}")) for k in range(1, levels + 1)]
    done = marked.withColumn(out, F.slice(F.array(*counts), F.lit(1), F.col(level).cast("int")))
    return done.drop(*[f"__reset{k}" for k in range(1, levels + 1)])


def counter_final(counted: DataFrame, group: list[str], ord: str = "ord", counter: str = "counter") -> DataFrame:
    return counted.groupBy(*group).agg(F.max_by(counter, ord).alias(counter))


def as_of(queries: DataFrame, updates: DataFrame, group: list[str], value: str, ord: str = "ord", default: Column | None = None, inclusive: bool = True) -> DataFrame:
    """queries with the value of the last update at or before each place (as-of join, one window, no range join)."""
    q = queries.withColumn("__q", F.lit(True)).withColumn(value, F.lit(None).cast(updates.schema[value].dataType))
    cols = [*group, ord, value]
    both = updates.select(*cols, F.lit(False).alias("__q"), *[F.lit(None).cast(q.schema[c].dataType).alias(c) for c in q.columns if c not in (*cols, "__q")]).unionByName(q)
    tie = F.col("__q").asc() if inclusive else F.col("__q").desc()
    over = Window.partitionBy(*group).orderBy(F.col(ord), tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(value, ignorenulls=True).over(over)
    found = both.withColumn(value, F.coalesce(last, default) if default is not None else last)
    return found.filter("__q").drop("__q")


def state_set(updates: DataFrame, group: list[str], value: str, init: Column, ord: str = "ord", out: str = "state") -> DataFrame:
    """The state after each update that sets it (null: no change)."""
    over = Window.partitionBy(*group).orderBy(ord).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return updates.withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(over), init))


def state_fold(
    updates: DataFrame, group: list[str], init: object, update: Callable[[object, dict[str, object]], object], kind: str, order: list[str], out: str = "state"
) -> DataFrame:
    """The state after each update that is any function of the state before; one group is one task.

    update(state, row) gives the next state.  What one key's updates do is
    sequential by nature; groups run side by side.
    """
    from pyspark.sql import types as T

    schema = T.StructType([*updates.schema.fields, T.StructField(out, T._parse_datatype_string(kind))])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        state, states = init, []
        for row in rows.to_dict("records"):
            state = update(state, row)
            states.append(state)
        return rows.assign(**{out: states})

    return updates.groupBy(*group).applyInPandas(run, schema)


def counter_fold(updates: DataFrame, group: list[str], order: list[str], functions: dict[str, Callable[[list[int]], list[int]]] | None = None) -> DataFrame:
    """updates(kind, level, numbers) -> `counter` after each: kind step, set or the name of a function."""
    named = functions or {}

    def update(state: object, row: dict[str, object]) -> object:
        now = list(state)
        if row["kind"] == "step":
            k = int(row["level"])
            now = (now + [0] * k)[:k]
            now[k - 1] += 1
            return now
        if row["kind"] == "set":
            return [int(x) for x in row["numbers"]]
        return named[row["kind"]](now)

    return state_fold(updates, group, [0], update, "array<bigint>", order, "counter")


def both(counted: DataFrame, group: list[str], counter: str = "counter", ord: str = "ord") -> DataFrame:
    """counted with the pair of each row's first number and the last one of its group."""
    last = F.last(F.get(counter, F.lit(0))).over(Window.partitionBy(*group).orderBy(ord).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return counted.withColumn("both", F.array(F.get(counter, F.lit(0)), last))


def page_counter(rows: DataFrame, group: list[str], page: str = "page", ord: str = "ord") -> DataFrame:
    """A counter that begins with 1 and moves on by page."""
    first = F.min(page).over(Window.partitionBy(*group))
    return rows.withColumn("page_counter", (F.col(page) - first + 1).cast("bigint"))
