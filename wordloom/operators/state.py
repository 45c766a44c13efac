"""Per-user state from ordered events: mastery levels, streaks, sessions, marks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType


def _runs(schema: StructType, keys: list[str]):
    """For ``mapInArrow`` over rows sorted by key: (keys, part, first, shift, low, high, seen, wrong) of each run of a key."""
    types = [f.type for f in to_arrow_schema(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, names = TaskContext.get().partitionId(), schema.names
        done: list[tuple] = []
        key, state = None, None

        def made() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) if done else [()] * len(types)
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], names=names)
            done.clear()
            return out

        for batch in batches:
            for *k, ok in zip(*[batch.column(c).to_pylist() for c in [*keys, "ok"]], strict=True):
                if state is None or k != key:
                    if state is not None:
                        done.append((*key, part, *state))
                    key, state = k, [int(ok == 1), 0, 0, 3, 1, int(ok == 0)]
                    continue
                step = 1 if ok == 1 else -1
                state[1] += step
                state[2] = min(max(state[2] + step, 0), 3)
                state[3] = min(max(state[3] + step, 0), 3)
                state[4] += 1
                state[5] += ok == 0
            yield made()
        if state is not None:
            done.append((*key, part, *state))
            yield made()

    return run


def mastery(events: DataFrame, keys: list[str], ok: Column, *order: str) -> DataFrame:
    """Level (0 to 3), seen and wrong of each key after all its events.

    The first answer sets 3 or 0; later ones move the level by one within 0 and 3. A step is a clamped shift, and so is a
    run of steps: x -> min(max(x + shift, low), high). Events are range-partitioned by key and order, so a hot key's lie in
    many tasks; each task reduces each run of a key to one row, and those few rows are composed in order.
    """
    rows = events.select(*keys, *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], ok.cast("int").alias("ok"))
    by = [*keys, *[f"_o{i}" for i in range(len(order))], "ok"]
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by).select(*keys, "ok")
    schema = StructType([placed.schema[k] for k in keys] + [StructField(c, LongType()) for c in ("part", "first", "shift", "low", "high", "seen", "wrong")])
    runs = placed.mapInArrow(_runs(schema, keys), schema)
    r = runs.groupBy(*keys).agg(F.sum("seen").alias("seen"), F.sum("wrong").alias("wrong"), F.array_sort(F.collect_list(F.struct("part", "first", "shift", "low", "high"))).alias("rs"))

    def compose(s: Column, x: Column) -> Column:
        step = F.when(x["first"] == 1, F.least(s + 1, F.lit(3))).otherwise(F.greatest(s - 1, F.lit(0)))
        begun = F.when(s == -1, F.when(x["first"] == 1, 3).otherwise(0)).otherwise(step)
        return F.least(F.greatest(begun + x["shift"], x["low"]), x["high"]).cast("int")

    return r.select(*keys, "seen", "wrong", F.aggregate("rs", F.lit(-1), compose).alias("level"))


def buckets(states: DataFrame, *by: str) -> DataFrame:
    """Strong, weak and fresh keys of each group."""
    return states.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(F.col("level") >= 3).alias("strong"), F.count_if((F.col("level") < 3) & (F.col("level") > 0)).alias("weak"), F.count_if(F.col("level") <= 0).alias("fresh"))


def streaks(days: DataFrame, user: str, day: str) -> DataFrame:
    """Each user's days, longest run of days, and the run that ends on the table's last day or the day before."""
    d = days.select(user, F.col(day).alias("d")).distinct()
    island = F.date_sub("d", F.row_number().over(Window.partitionBy(user).orderBy("d")))
    runs = d.withColumn("g", island).groupBy(user, "g").agg(F.count("*").alias("n"), F.max("d").alias("last"))
    today = d.agg(F.max("d").alias("today"))
    runs = runs.join(F.broadcast(today))
    return runs.groupBy(user).agg(F.sum("n").alias("days"), F.max("n").alias("longest"), F.coalesce(F.max(F.when(F.col("last") >= F.date_sub("today", 1), F.col("n"))), F.lit(0)).alias("current"))


def sessions(events: DataFrame, user: str, at: str, tie: str, gap_seconds: int) -> DataFrame:
    """Events with ``session``: its number within the user, a new one after each gap."""
    w = Window.partitionBy(user).orderBy(at, tie)
    new = F.lag(at).over(w).isNull() | (F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(w).cast("timestamp")) > gap_seconds * 1_000_000)
    return events.withColumn("_new", new.cast("int")).withColumn("session", F.sum("_new").over(w)).drop("_new")


def carry_forward(rows: DataFrame, by: str, value: Column, *order: str) -> DataFrame:
    """``carried``: the last value that isn't null, up to and with the row."""
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("carried", F.last(value, ignorenulls=True).over(w))


def next_mark(rows: DataFrame, by: str, *order: str) -> DataFrame:
    """``next``: the first order column of the following row."""
    return rows.withColumn("next", F.lead(order[0]).over(Window.partitionBy(by).orderBy(*order)))


def failing(rows: DataFrame, by: str, bad: Column, n: int, *order: str) -> DataFrame:
    """Whether each group's last ``n`` rows all failed (false with fewer rows)."""
    last = rows.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy(*[F.col(o).desc() for o in order]))).filter(F.col("rn") <= n)
    return last.groupBy(by).agg(F.count("*").alias("checked"), (F.bool_and(F.coalesce(bad, F.lit(False))) & (F.count("*") == n)).alias("failing"))
