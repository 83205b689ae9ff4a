"""Operators over several tables that foreign keys tie together: deletes that cascade, copies parent first, deep copies under new ids.

Tables are a dict of DataFrames with a column `id` each. A key says that a column of the child holds an id of the parent, or null.
The keys are the schema, a handful of rows, so their order is worked out by the driver; all rows go by joins.
"""

from __future__ import annotations

from functools import reduce
from graphlib import TopologicalSorter
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.operators.progress import numbered


class Key(NamedTuple):
    child: str
    column: str
    parent: str


def parents_first(tables: dict[str, DataFrame], keys: list[Key]) -> list[str]:
    """Names of the tables, each behind those that its keys lead to; a key of a table to itself is no hindrance, a cycle of several raises CycleError."""
    graph = {name: {k.parent for k in keys if k.child == name and k.parent != name} for name in tables}
    return list(TopologicalSorter(graph).static_order())


def cascade(tables: dict[str, DataFrame], keys: list[Key], doomed: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables without the doomed rows (id, by table) and without all rows that lead to one of them, over any number of keys.

    A key of a table to itself is followed until no more rows are found. Rows whose key is null stay.
    """
    out, gone = {}, {}
    for name in parents_first(tables, keys):
        rows = tables[name]
        found = [doomed[name].select("id")] if name in doomed else []
        found += [rows.join(gone[k.parent].withColumnRenamed("id", k.column), k.column, "left_semi").select("id") for k in keys if k.child == name and k.parent in gone and k.parent != name]
        if not found:
            out[name] = rows
            continue
        dead = reduce(DataFrame.union, found).distinct()
        for k in (k for k in keys if k.child == name and k.parent == name):
            fresh = dead
            while not fresh.isEmpty():
                fresh = rows.join(fresh.withColumnRenamed("id", k.column), k.column, "left_semi").select("id").join(dead, "id", "left_anti").distinct()
                dead = dead.union(fresh)
        gone[name] = dead
        out[name] = rows.join(dead, "id", "left_anti")
    return out


def copied(source: dict[str, DataFrame], target: dict[str, DataFrame], keys: list[Key], force: bool = False) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """The target's tables with the source's rows, ids kept, parents before children; and by table the rows refused, as they lead to a row that is in neither.

    A target that holds rows of a table without parents is left as it is, unless force is given: then rows that it has already
    stay as they are, and the others are added.
    """
    order = parents_first(source, keys)
    roots = [n for n in order if not any(k.child == n for k in keys)]
    if not force and any(not target[n].isEmpty() for n in roots):
        return dict(target), {n: source[n].limit(0) for n in order}
    out, refused = {}, {}
    for name in order:
        new = source[name].join(target[name].select("id"), "id", "left_anti").select(source[name].columns)
        held = F.lit(True)
        for n, k in enumerate(k for k in keys if k.child == name):
            known = (target[name].select("id").union(new.select("id")) if k.parent == name else out[k.parent]).select(F.col("id").alias(k.column), F.lit(True).alias(f"_held{n}"))
            new = new.join(known.distinct(), k.column, "left")
            held = held & (F.col(k.column).isNull() | F.col(f"_held{n}").isNotNull())
        columns = source[name].columns
        refused[name] = new.filter(~held).select(columns)
        out[name] = target[name].unionByName(new.filter(held).select(columns))
    return out, refused


def next_ids(tables: dict[str, DataFrame]) -> DataFrame:
    """table, next_id: where each table's numbering goes on; 1 for an empty one."""
    return reduce(DataFrame.union, [df.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("next_id")).select(F.lit(name).alias("table"), "next_id") for name, df in tables.items()])


def deep_copied(tables: dict[str, DataFrame], keys: list[Key], root: str, chosen: Column, changes: dict[str, Column] | None = None) -> dict[str, DataFrame]:
    """New rows, by table: copies of the root's rows that are chosen and of all rows that lead to them, under ids that follow the table's largest.

    In every table copies are numbered in the order of the ids that they come from; their keys lead to the copies of the rows
    that the originals lead to, or stay where these are not copied. changes: columns of the root's copies. Of tables that no
    copied row belongs to, none.
    """
    new_ids: dict[str, DataFrame] = {}
    out: dict[str, DataFrame] = {}
    for name in parents_first(tables, keys):
        rows, own = tables[name], [k for k in keys if k.child == name and k.parent in new_ids]
        if name != root and not own:
            continue
        if name == root:
            taken = rows.filter(chosen)
        else:
            hits = [rows.join(new_ids[k.parent].select(F.col("old").alias(k.column)), k.column, "left_semi").select("id") for k in own]
            taken = rows.join(reduce(DataFrame.union, hits).distinct(), "id", "left_semi")
        last = rows.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
        placed = numbered(taken.select(F.col("id").alias("old")), "old").crossJoin(F.broadcast(last))
        new_ids[name] = placed.select("old", (F.col("_last") + F.col("place")).alias("new"))
        copy = taken.join(new_ids[name].withColumnRenamed("old", "id"), "id").drop("id").withColumnRenamed("new", "id")
        for k in own + [k for k in keys if k.child == name and k.parent == name]:
            moved = new_ids[k.parent].select(F.col("old").alias(k.column), F.col("new").alias("_to"))
            copy = copy.join(moved, k.column, "left").withColumn(k.column, F.coalesce("_to", k.column)).drop("_to")
        out[name] = copy.withColumns(changes or {}).select(rows.columns) if name == root else copy.select(rows.columns)
    return out
