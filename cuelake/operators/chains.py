"""Steps that depend on the row before, along tracks of any length: rows lie in parts by ranges, so no task has to hold a job.

What crosses from one part to the next is one row for each part and key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.sources import storage


def parted(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows as a table with _part: ranges of (keys, order), ascending. A part may hold many keys, and a key may lie in many parts."""
    dealt = rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    return storage.written(dealt, "parts")


def _in_part(keys: list[str], order: list[str]) -> Window:
    return Window.partitionBy("_part", *keys).orderBy(*order)


def with_next(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], name: str = "_next") -> DataFrame:
    """rows (from parted) with a struct of the columns of the row that follows in the order of its key; null for the last one."""
    w = _in_part(keys, order)
    own = F.struct(*columns)
    first = rows.groupBy("_part", *keys).agg(F.min_by(own, F.struct(*order)).alias("_first"))
    border = first.withColumn("_border", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_part"))).drop("_first")
    return rows.withColumn("_own", F.lead(own).over(w)).join(border, ["_part", *keys]).withColumn(name, F.coalesce("_own", "_border")).drop("_own", "_border")


def _state_before(w: Window, to0: Column, to1: Column, at_start: Column) -> Column:
    """The state of a machine of two states before each row of w, where a row leads from false to to0 and from true to to1.

    A row either sets the state, or keeps or flips it. So the state is what the last row that sets it says, flipped once for each
    flip since: two running sums, whatever the length.
    """
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    flips = lambda frame: F.coalesce(F.sum(F.when(to0 & ~to1, 1).otherwise(0)).over(frame), F.lit(0))
    # The flips that a row which sets the state has before it stand in _flips.
    last = F.last(F.when(to0 == to1, F.struct(to0.alias("v"), F.col("_flips").alias("f"))), True).over(before)
    return F.when(last.isNull(), at_start != (flips(before) % 2 == 1)).otherwise(last["v"] != ((flips(before) - last["f"]) % 2 == 1))


def _machine(rows: DataFrame, w: Window, to0: str, to1: str, start: Column, name: str) -> DataFrame:
    counted = rows.withColumn("_flips", F.coalesce(F.sum(F.when(F.col(to0) & ~F.col(to1), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return counted.withColumn(name, _state_before(w, F.col(to0), F.col(to1), start)).drop("_flips")


def with_state(rows: DataFrame, keys: list[str], order: list[str], to0: str, to1: str, name: str = "_state") -> DataFrame:
    """rows (from parted) with the state in which the fold along each key reaches them; it begins with false.

    to0, to1: boolean columns, the state behind the row if the one before it is false or true. What a whole part does to the
    state is again a row with two such columns, so the fold over parts is the same one over a row for each part.
    """
    w = _in_part(keys, order)
    after = lambda s: F.when(F.col(s), F.col(to1)).otherwise(F.col(to0))
    both = _machine(_machine(rows, w, to0, to1, F.lit(False), "_s0"), w, to0, to1, F.lit(True), "_s1")
    last = both.groupBy("_part", *keys).agg(*(F.max_by(after(s), F.struct(*order)).alias(a) for s, a in (("_s0", "_a0"), ("_s1", "_a1"))))
    entry = _machine(last, Window.partitionBy(*keys).orderBy("_part"), "_a0", "_a1", F.lit(False), "_enters").select("_part", *keys, "_enters")
    return both.join(entry, ["_part", *keys]).withColumn(name, F.when(F.col("_enters"), F.col("_s1")).otherwise(F.col("_s0"))).drop("_s0", "_s1", "_enters")


def running_max(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str, descending: bool = False) -> DataFrame:
    """rows (from parted) with the largest value of the rows before them in the order of their key, or with the smallest one behind them if descending; null where there is none."""
    f, sort = (F.min, F.desc) if descending else (F.max, F.asc)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    own = f(value).over(before(Window.partitionBy("_part", *keys).orderBy(*(sort(c) for c in order))))
    parts = rows.groupBy("_part", *keys).agg(f(value).alias("_m"))
    entry = parts.withColumn("_before", f("_m").over(before(Window.partitionBy(*keys).orderBy(sort("_part"))))).drop("_m")
    pick = F.least if descending else F.greatest
    return rows.withColumn("_inside", own).join(entry, ["_part", *keys]).withColumn(name, pick("_inside", "_before")).drop("_inside", "_before")


def running_count(rows: DataFrame, keys: list[str], order: list[str], flag: Column, name: str) -> DataFrame:
    """rows (from parted) with how many rows up to them, in the order of their key, have the flag."""
    one = F.when(flag, 1).otherwise(0)
    parts = rows.groupBy("_part", *keys).agg(F.sum(one).alias("_n"))
    entry = parts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    up_to = F.sum(one).over(_in_part(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_inside", up_to).join(entry, ["_part", *keys]).withColumn(name, F.col("_inside") + F.col("_before")).drop("_inside", "_before")
