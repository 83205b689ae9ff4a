"""Centroid clustering by dual-tree Lloyd rounds over integer vectors: exact assignments, with whole subtrees pruned by distance bounds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import written

#: Vectors under one cover tree. A tree is built and searched in one batch of a task; a task has as many trees as it needs.
BLOCK = 1024
#: Vectors of a leaf, which are compared with the centroids that are left for it one by one.
LEAF = 8
#: Largest absolute component, so that squared distances of 64 components fit into 64 bits after scaling by 256.
LARGEST = float(1 << 19)
#: Bounds are worked out in doubles; what is pruned is farther away by more than this share.
MARGIN = 1e-9


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    d = a - b
    return np.einsum("...i,...i->...", d, d)


@dataclass
class CoverTree:
    """Nodes over points, in breadth-first order; the points under a node are order[begin] to order[end].

    The children of a node with radius r cover its points within half the power of two that holds r; their centres, points
    themselves and the first of them the node's own, lie farther apart than that. Points that are equal share a leaf.
    """

    order: np.ndarray
    centre: np.ndarray  # the place in order of the point that the node is centred on
    radius: np.ndarray  # largest distance of a point under the node from the centre
    begin: np.ndarray
    end: np.ndarray
    kids: np.ndarray  # first child
    n_kids: np.ndarray

    @classmethod
    def over(cls, points: np.ndarray, leaf: int) -> CoverTree:
        away = np.sqrt(squared(points, points[0]).astype(np.float64))
        todo = [(0, np.arange(len(points)), away)]
        kids, n_kids = [], []
        at = 0
        while at < len(todo):
            centre, members, away = todo[at]
            at += 1
            kids.append(len(todo))
            reach = away.max()
            if reach == 0 or len(members) <= leaf:
                n_kids.append(0)
                continue
            cover = 2.0 ** (np.ceil(np.log2(reach)) - 1)
            first = len(todo)
            near = away <= cover
            todo.append((centre, members[near], away[near]))
            rest = members[~near]
            while len(rest):
                own = np.sqrt(squared(points[rest], points[rest[0]]).astype(np.float64))
                near = own <= cover
                todo.append((int(rest[0]), rest[near], own[near]))
                rest = rest[~near]
            n_kids.append(len(todo) - first)
        sizes = np.array([len(t[1]) for t in todo])
        begin, kids, n_kids = np.zeros(len(todo), np.int64), np.array(kids), np.array(n_kids)
        order = np.zeros(len(points), np.int64)
        for node, (_, members, _) in enumerate(todo):
            if n_kids[node]:
                own = slice(kids[node], kids[node] + n_kids[node])
                begin[own] = begin[node] + np.cumsum(sizes[own]) - sizes[own]
            else:
                order[begin[node] : begin[node] + len(members)] = members
        return cls(order, np.argsort(order)[np.array([t[0] for t in todo])], np.array([t[2].max() for t in todo]), begin, begin + sizes, kids, n_kids)


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... n numbers for each."""
    ends = np.cumsum(n)
    return np.repeat(first - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)


def nearest(tree: CoverTree, points: np.ndarray, over: CoverTree, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each of the points, which stand in the tree's order; of equally near ones that with the smaller number.

    Both trees are gone down together, one level a step. A centroid node goes from a vector node's list once none of its
    centroids can be as near to any of the node's vectors as the nearest centre seen for it is to all of them. A vector node
    with one centroid left is done with all its vectors; at a leaf the vectors are compared with what is left.
    """
    out = np.full(len(points), -1, np.int64)
    leaves = np.flatnonzero(over.n_kids == 0)
    leaves = leaves[np.argsort(over.begin[leaves])]
    of_leaf = np.zeros(len(over.centre), np.int64)
    of_leaf[leaves] = np.minimum.reduceat(over.order, over.begin[leaves])
    middle, heart = points[tree.centre], centroids[over.order[over.centre]]
    v, c = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(v):
        d = np.sqrt(squared(middle[v], heart[c]).astype(np.float64))
        starts = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        sizes = np.diff(starts, append=len(v))
        bound = np.repeat(np.minimum.reduceat(d, starts), sizes) + tree.radius[v]
        left = d - tree.radius[v] - over.radius[c] <= bound + MARGIN * (1 + bound + d)
        v, c = v[left], c[left]
        starts = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        sizes = np.diff(starts, append=len(v))
        alone = (sizes == 1) & (over.n_kids[c[starts]] == 0)
        nodes = v[starts[alone]]
        n = tree.end[nodes] - tree.begin[nodes]
        out[_spread(tree.begin[nodes], n)] = np.repeat(of_leaf[c[starts[alone]]], n)
        open_ = np.repeat(~alone, sizes)
        v, c = v[open_], c[open_]
        at_leaf = tree.n_kids[v] == 0
        if at_leaf.any():
            # A vector node of a few points meets the centroids below what is left for it.
            lv, lc = v[at_leaf], c[at_leaf]
            n = over.end[lc] - over.begin[lc]
            lv, number = np.repeat(lv, n), over.order[_spread(over.begin[lc], n)]
            n = tree.end[lv] - tree.begin[lv]
            place, number = _spread(tree.begin[lv], n), np.repeat(number, n)
            order = np.argsort(place, kind="stable")
            place, number = place[order], number[order]
            d = squared(points[place], centroids[number])
            starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            least = np.repeat(np.minimum.reduceat(d, starts), np.diff(starts, append=len(place)))
            out[place[starts]] = np.minimum.reduceat(np.where(d == least, number, len(centroids)), starts)
            v, c = v[~at_leaf], c[~at_leaf]
        # Both sides go one level down; a centroid leaf stays.
        inner = over.n_kids[c] > 0
        n = np.where(inner, over.n_kids[c], 1)
        v, c = np.repeat(v, n), _spread(np.where(inner, over.kids[c], c), n)
        n = tree.n_kids[v]
        v, c = _spread(tree.kids[v], n), np.repeat(c, n)
        order = np.argsort(v, kind="stable")
        v, c = v[order], c[order]
    return out


def usable(vector: Column, dims: int) -> Column:
    """Whether a vector has all its components, each a finite number."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(vector) == dims) & ~F.exists(vector, bad), F.lit(False))


NODES = ("centre int", "radius double", "begin int", "end int", "kids int", "n_kids int")


def blocks_of(vectors: DataFrame, dims: int, block: int) -> DataFrame:
    """One row per block of vectors (id, q): ids and the vectors (binary, 32-bit numbers) in the order of their cover tree, and its nodes."""

    def made(ids: list[pa.Array], parts: list[np.ndarray]) -> pa.RecordBatch:
        points = np.concatenate(parts)
        tree = CoverTree.over(points, LEAF)
        names = pa.concat_arrays(ids).take(pa.array(tree.order))
        nodes = [pa.array([getattr(tree, f.split()[0])], pa.list_(pa.float64() if "double" in f else pa.int32())) for f in NODES]
        return pa.RecordBatch.from_arrays([pa.array([names], pa.list_(names.type)), pa.array([points[tree.order].astype("<i4").tobytes()], pa.binary()), *nodes], ["ids", "points", *(f.split()[0] for f in NODES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, held = [], [], 0
        for batch in batches:
            q = batch.column("q").flatten().to_numpy().reshape(-1, dims)
            at = 0
            while at < len(q):
                n = min(block - held, len(q) - at)
                ids.append(batch.column("id").slice(at, n))
                parts.append(q[at : at + n])
                at, held = at + n, held + n
                if held == block:
                    yield made(ids, parts)
                    ids, parts, held = [], [], 0
        if held:
            yield made(ids, parts)

    kind = vectors.schema["id"].dataType.simpleString()
    return vectors.mapInArrow(run, f"ids array<{kind}>, points binary, " + ", ".join(f"{f.split()[0]} array<{f.split()[1]}>" for f in NODES))


def _read(row: dict, dims: int) -> tuple[CoverTree, np.ndarray]:
    points = np.frombuffer(row["points"], "<i4").reshape(-1, dims).astype(np.int64)
    return CoverTree(np.arange(len(points)), *(np.array(row[f.split()[0]]) for f in NODES)), points


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """ids, points and clusters of each block."""
    over = CoverTree.over(centroids, 1)
    for batch in batches:
        for r in range(batch.num_rows):
            row = {c: batch.column(c)[r].as_py() for c in batch.schema.names if c != "ids"}
            tree, points = _read(row, centroids.shape[1])
            yield batch.column("ids")[r].values, points, nearest(tree, points, over, centroids)


def moved(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: each the floored mean of the vectors nearest to it; one without vectors stays.

    A task adds up its vectors; its sums, a row for each centroid at most, are added up by Spark in exact decimals.
    """
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, dims + 1), np.int64)
        for _, points, cluster in _assigned(batches, centroids):
            order = np.argsort(cluster, kind="stable")
            used, starts = np.unique(cluster[order], return_index=True)
            sums[used, :dims] += np.add.reduceat(points[order], starts)
            sums[used, dims] += np.diff(starts, append=len(points))
        full = np.flatnonzero(sums[:, dims])
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(list(sums[full]), pa.list_(pa.int64()))], ["cluster", "sums"])

    totals = blocks.mapInArrow(run, "cluster int, sums array<long>").select("cluster", F.posexplode("sums").alias("place", "x"))
    rows = totals.groupBy("cluster", "place").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("x")).collect()  # k * (dims + 1) rows at most
    sums = {(r.cluster, r.place): int(r.x) for r in rows}
    new = centroids.copy()
    for cluster in {r.cluster for r in rows}:
        new[cluster] = [sums[cluster, d] // sums[cluster, dims] for d in range(dims)]
    return new


def clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, seed: int = 2, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """One row per kept vector: id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Kept are vectors with `dims` components, none of them null or not finite; each becomes floor(scale * x), so all that follows
    is exact in 64-bit numbers (a component beyond LARGEST raises an error: distances would leave them). The first centroids
    are the k vectors with the smallest sha256 of `seed:id`, those of equal ids by their components; fewer vectors make
    fewer centroids. Ties in distance go to the smaller number, centroids without vectors stay where they are.

    Cover trees over blocks of vectors are built once and written to the shared folder; each round sends k centroids out and
    gets k sums back, so no vector is shuffled in any round, and a vector that a third of all rows share is one point of each
    tree. Null ids are hashed as the empty text. Repeated rows are vectors of their own; extra columns are ignored; an empty
    table, or one without kept vectors, gives no rows.
    """
    spark = vectors.sparkSession
    v = F.col("_v")
    kept = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("_v")).filter(usable(v, dims))
    number = lambda x: F.when(F.abs(x) > LARGEST, F.raise_error(F.lit(f"a component beyond {LARGEST}")).cast("double")).otherwise(x.cast("double"))
    kept = kept.select("id", F.transform(v, lambda x: F.floor(number(x) * scale).cast("long")).alias("q"))
    stored = written(blocks_of(kept, dims, block), "vector-blocks")
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    centroids = np.array([r.q for r in kept.orderBy(mark, "q").limit(k).collect()], np.int64).reshape(-1, dims)
    kind = kept.schema["id"].dataType.simpleString()
    if not len(centroids):
        return spark.createDataFrame([], f"{id_col} {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved(stored, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, points, cluster in _assigned(batches, centroids):
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(squared(points, centroids[cluster]))], ["id", "cluster", "distance"])

    found = written(stored.mapInArrow(run, f"id {kind}, cluster int, distance long"), "clusters")
    sums = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows at most
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    rows = [(c, s, sum(sums.values()), digest(centroids[c])) for c, s in sums.items()]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
