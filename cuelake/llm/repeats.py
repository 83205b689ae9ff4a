"""Repeated passages: every byte that lies in a string of `length` bytes which also starts elsewhere.

Windows that are equal have the same least n-gram at the same offset (their anchor), so runs of windows with one anchor are
dealt out by it, lined up at it, and compared by a Burrows-Wheeler transform of the bytes that precede each lined-up column.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import as_bytes, row_key, slices, written
from cuelake.llm.shingles import OF_BYTE, mixed

LENGTH = 400
#: Contents of one anchor that one task compares; those of an anchor with more are first dealt out anew, by further anchors.
MOST_CONTENTS = 2048
#: Suffixes of an interval that are looked at one by one; of a longer one, each byte's suffixes are searched instead.
STEPS = 24
#: Contents that are transformed at a time.
AT_ONCE = 4096
SEGMENT = 1 << 22
POSITION_BITS = 24
#: A run of windows: its row's key, where the text that it was found in begins, its first window, their end, their anchor, their group, the hash of the run's bytes, how many runs it stands for.
RUN = "a long, b long, base long, first long, until long, anchor long, gram long, c long, d long, n long"


def gram_size(length: int) -> int:
    return max(1, min(16, length // 4))


def least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """The least of values[i : i + width] for each i that has so many."""
    size, least = 1, values
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = width - size
    return np.minimum(least[:-rest], least[rest:]) if rest else least


def window_runs(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of one text with the same anchor: first window, end of the windows (exclusive), anchor, hash of its n-gram."""
    k = gram_size(length)
    h = OF_BYTE[data]
    total = np.zeros(len(data) - k + 1, np.uint64)
    for j in range(k):
        total = mixed_step(total, h[j : len(data) - k + 1 + j])
    grams = mixed(total)
    places = np.arange(len(grams), dtype=np.uint64)
    keyed = (grams >> np.uint64(POSITION_BITS) << np.uint64(POSITION_BITS)) | places
    least = least_in_windows(keyed, length - k + 1)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    anchors = (least[first] & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64)
    return first, np.append(first[1:], len(least)), anchors, grams[anchors]


def mixed_step(total: np.ndarray, value: np.ndarray) -> np.ndarray:
    return total * np.uint64(0x9E3779B97F4A7C15) + value


def runs(docs: DataFrame, length: int, id_col: str, text_col: str) -> DataFrame:
    """a and b (the row's key), first, until, anchor (bytes of the text), gram, c and d (a hash of the run's bytes and of the anchor's place in them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = as_bytes(batch.column("text"))
            raw = data.tobytes()
            keys_a, keys_b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            out = [[] for _ in range(8)]
            for row in np.flatnonzero(np.diff(offsets) >= length):
                begin, end = int(offsets[row]), int(offsets[row + 1])
                # A longer text goes in segments that overlap by all but one byte of a window.
                for at in range(begin, end - length + 1, SEGMENT):
                    stop = min(end, at + SEGMENT + length - 1)
                    first, until, anchor, gram = window_runs(data[at:stop], length)
                    hashes = [hashlib.blake2b(raw[at + s : at + e - 1 + length], digest_size=16, salt=int(p - s).to_bytes(8, "little")).digest() for s, e, p in zip(first.tolist(), until.tolist(), anchor.tolist())]
                    content = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
                    shift = at - begin
                    for column, values in zip(out, (np.full(len(first), keys_a[row]), np.full(len(first), keys_b[row]), first + shift, until + shift, anchor + shift, gram.view(np.int64), content[:, 0], content[:, 1])):
                        column.append(values)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["a", "b", "first", "until", "anchor", "gram", "c", "d"])

    source = docs.select(row_key(id_col, text_col).alias("_key"), F.col(text_col).alias("text")).select("_key.a", "_key.b", "text")
    return source.mapInArrow(run, "a long, b long, first long, until long, anchor long, gram long, c long, d long")


def common_prefixes(groups: np.ndarray, lefts: list[bytes], rights: list[bytes], length: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each column d (suffixes that start d bytes before the anchor): the rows in the suffixes' order, by group, and the length of the prefix that each has in common with the one before it, or -1 for `length` and more.

    The transform: the byte before each suffix, in the suffixes' order. Sorting stably by it gives the order of the next
    column (the LF mapping). Common prefixes are found breadth first, in increasing length: an interval of suffixes that ends
    at a prefix of length n is extended backwards by each byte before its suffixes; where the extended interval ends, a
    boundary without a length yet gets n + 1. It stops below `length`, so what is still open is as long or longer.
    """
    n = len(groups)
    order = np.array(sorted(range(n), key=lambda i: (groups[i], rights[i])), np.int64)
    widest = max(map(len, rights))
    sizes = np.array([len(r) for r in rights])
    matrix = np.frombuffer(b"".join(r.ljust(widest, b"\0") for r in rights), np.uint8).reshape(n, widest)
    differ = matrix[order[1:]] != matrix[order[:-1]]
    known = np.where(differ.any(axis=1), differ.argmax(axis=1), widest)
    known = np.minimum(known, np.minimum(sizes[order[1:]], sizes[order[:-1]]))
    known = np.where(groups[order[1:]] == groups[order[:-1]], np.minimum(known, length), 0)
    deepest = max(map(len, lefts))
    before = np.frombuffer(b"".join(x[::-1].ljust(deepest, b"\0") for x in lefts), np.uint8).reshape(n, deepest) if deepest else np.zeros((n, 0), np.uint8)
    depth = np.array([len(x) for x in lefts])
    # All columns lie in one line; `to` is the LF mapping, `after` the next suffix of its column with the same byte before it.
    orders, prefixes, to, after, sources, run_starts, base = [order], [np.concatenate([[0], known])], [], [], [], [], 0
    for d in range(deepest):
        order = orders[-1]
        has = np.flatnonzero(depth[order] > d)
        key = groups[order[has]] * 256 + before[order[has], d]
        by_key = np.argsort(key, kind="stable")
        moved, key = has[by_key], key[by_key]
        same = key[1:] == key[:-1]
        lf, following = np.full(len(order), -1, np.int64), np.full(len(order), -1, np.int64)
        lf[moved] = base + len(order) + np.arange(len(moved))
        following[moved[:-1][same]] = base + moved[1:][same]
        to.append(lf)
        after.append(following)
        sources.append(base + moved)
        run_starts.append(np.concatenate([[True], ~same])[: len(moved)])
        orders.append(order[moved])
        prefixes.append(np.concatenate([[0], np.where(same, -1, 0)])[: len(moved)])
        base += len(order)
    to.append(np.full(len(orders[-1]), -1, np.int64))
    after.append(np.full(len(orders[-1]), -1, np.int64))
    to, after, prefix = np.concatenate(to), np.concatenate(after), np.concatenate(prefixes)
    # A cell holds the suffixes of one column and group; a run those of a cell with the same byte before them, in order.
    group_of = groups[np.concatenate(orders)]
    fresh = np.concatenate([[True], group_of[1:] != group_of[:-1]])
    starts = np.cumsum([len(o) for o in orders])[:-1]
    fresh[starts[starts < len(fresh)]] = True
    cell = np.cumsum(fresh) - 1
    source = np.concatenate([*sources, np.zeros(0, np.int64)])
    run_at = np.flatnonzero(np.concatenate([*run_starts, np.zeros(0, bool)]))
    run_end = np.append(run_at[1:], len(source))
    run_of = np.repeat(np.arange(len(run_at)), run_end - run_at)
    searched = run_of * len(prefix) + source
    run_cell = cell[source[run_at]]
    seeds = np.argsort(prefix[:n], kind="stable")
    seed_at = np.searchsorted(prefix[:n][seeds], np.arange(length + 1))
    frontier = np.flatnonzero(prefix == 0)
    for level in range(length - 1):
        if level:
            frontier = np.concatenate([frontier, seeds[seed_at[level] : seed_at[level + 1]]])
        found = []
        end, t = frontier, frontier - 1
        inside, step = t >= 0, 0
        while inside.any():
            end, t = end[inside], t[inside]
            if (step := step + 1) > STEPS:
                # The same boundaries, found by byte: the first suffix of each run at or after the interval's end, if one is before it.
                a, b = np.searchsorted(run_cell, cell[t]), np.searchsorted(run_cell, cell[t], "right")
                run = np.repeat(a - (np.cumsum(b - a) - (b - a)), b - a) + np.arange(int((b - a).sum()))
                at = np.searchsorted(searched, run * len(prefix) + np.repeat(end, b - a))
                target = n + at[(at > run_at[run]) & (at < run_end[run])]
                target = target[prefix[target] < 0]
                prefix[target] = level + 1
                found.append(target)
                break
            crosses = t[(after[t] >= end)]
            target = to[crosses] + 1
            target = target[prefix[target] < 0]
            if len(target):
                prefix[target] = level + 1
                found.append(target)
            inside = (prefix[t] < 0) | (prefix[t] > level)
            t = t - 1
        frontier = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        if not len(frontier) and seed_at[level + 1] == seed_at[length]:
            break
    out, at = [], 0
    for order in orders:
        out.append(prefix[at : at + len(order)])
        at += len(order)
    return orders, out


def repeated_windows(groups: np.ndarray, contents: list[bytes], anchors: list[int], length: int) -> list[np.ndarray]:
    """For each content, whether each of its windows also occurs in another content of its group."""
    orders, prefixes = common_prefixes(groups, [c[:p] for c, p in zip(contents, anchors)], [c[p:] for c, p in zip(contents, anchors)], length)
    at_anchor, counts = np.array(anchors), np.array([len(c) - length + 1 for c in contents])
    flags = np.zeros((len(contents), int(counts.max())), bool)
    for d, (order, prefix) in enumerate(zip(orders, prefixes)):
        long = (prefix < 0) | (prefix >= length)
        long[:-1] |= long[1:]
        rows = order[long]
        at = at_anchor[rows] - d
        inside = (at >= 0) & (at < counts[rows])
        flags[rows[inside], at[inside]] = True
    return [f[:n] for f, n in zip(flags, counts)]


def intervals(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def compared(contents: DataFrame, length: int, at_once: int) -> DataFrame:
    """a, b, first, until: runs of windows of the contents with n = 1 that another content of their anchor holds as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def done(rows: list[dict]) -> Iterator[pa.RecordBatch]:
            groups = np.unique([r["gram"] for r in rows], return_inverse=True)[1]
            flags = repeated_windows(groups, [r["content"] for r in rows], [r["anchor"] - r["first"] for r in rows], length)
            out = [(r["a"], r["b"], r["first"] + s, r["first"] + e) for r, f in zip(rows, flags) if r["n"] == 1 for s, e in intervals(f)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(4)], ["a", "b", "first", "until"])

        for batch in slices(batches, "content"):
            for r in batch.to_pylist():
                if len(held) >= at_once and r["gram"] != held[-1]["gram"]:
                    yield from done(held)
                    held = []
                held.append(r)
        if held:
            yield from done(held)

    return contents.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, "a long, b long, first long, until long")


def finer(contents: DataFrame, length: int, pieces: int) -> DataFrame:
    """The contents' windows as runs again, by more than their anchor: the least n-gram of each of `pieces` equal parts of a window, and its place.

    Windows that are equal have all of these in common, so they stay in one group; those of a hot anchor that differ part.
    With as many pieces as bytes, a group holds the windows that are equal, and nothing is left to compare.
    """
    width = length // pieces
    k = gram_size(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "content", 1 << 18):
            data, offsets = as_bytes(batch.column("content"))
            raw = data.tobytes()
            rows, out = {c: batch.column(c).to_numpy() for c in ("a", "b", "n", "first", "anchor", "gram")}, [[] for _ in range(6)]
            for row, (begin, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                grams = np.zeros(end - begin - k + 1, np.uint64)
                for j in range(k):
                    grams = mixed_step(grams, OF_BYTE[data[begin + j : end - k + 1 + j]])
                grams = mixed(grams)
                keyed = (grams >> np.uint64(POSITION_BITS) << np.uint64(POSITION_BITS)) | np.arange(len(grams), dtype=np.uint64)
                least = least_in_windows(keyed, width - k + 1)
                windows = end - begin - length + 1
                of_pieces = least[np.arange(windows)[:, None] + np.arange(pieces) * width]
                first = np.flatnonzero(np.concatenate([[True], (of_pieces[1:] != of_pieces[:-1]).any(axis=1)]))
                until = np.append(first[1:], windows)
                places = (of_pieces[first] & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64)
                place = int(rows["anchor"][row] - rows["first"][row])
                key = np.full(len(first), rows["gram"][row]).view(np.uint64)
                for j in range(pieces):
                    key = mixed(mixed_step(mixed_step(key, grams[places[:, j]]), (places[:, j] - place).view(np.uint64)))
                hashes = [hashlib.blake2b(raw[begin + s : begin + e - 1 + length], digest_size=16, salt=(place - s).to_bytes(8, "little")).digest() for s, e in zip(first.tolist(), until.tolist())]
                content = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
                for column, values in zip(out, (np.full(len(first), row), first, until, key.view(np.int64), content[:, 0], content[:, 1])):
                    column.append(values)
            if out[0]:
                row, first, until, key, c, d = map(np.concatenate, out)
                base = rows["first"][row]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rows["a"][row], rows["b"][row], base, first + base, until + base, rows["anchor"][row], key, c, d, rows["n"][row])], RUN.replace(" long", "").split(", "))

    return contents.mapInArrow(run, RUN)


def settled(these: DataFrame, texts: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Of runs: a table of the contents that have to be compared, with their bytes; and a, b, first, until of the runs whose content occurs more than once."""
    contents = these.groupBy("gram", "c", "d").agg(F.sum("n").alias("n"), F.min(F.struct("a", "b", "base", "first", "until", "anchor")).alias("one"))
    contents = written(contents.select("gram", "c", "d", "n", "one.*"), "contents")
    anchors = contents.groupBy("gram").agg(F.count("*").alias("contents"), F.count_if(F.col("n") == 1).alias("single")).filter("contents > 1 AND single > 0")
    unsettled = contents.join(anchors, "gram").groupBy("a", "b", "base").agg(F.collect_list(F.struct("gram", "first", "until", "anchor", "n", "contents")).alias("_parts"))
    own = texts.join(unsettled, ["a", "b", "base"]).dropDuplicates(["a", "b", "base"])
    begin = F.col("_part.first") - F.col("base")
    parts = own.select("a", "b", "base", "_bytes", F.explode("_parts").alias("_part")).select("a", "b", "_part.*", F.substring("_bytes", begin.cast("int") + 1, (F.col("_part.until") - F.col("_part.first")).cast("int") + (length - 1)).alias("content"))
    # By another key than the one the counts were dealt by, so that a hot content's runs can be split.
    flipped = lambda df: df.withColumn("_c", F.col("c").bitwiseXOR(F.lit(1)))
    copies = flipped(contents.filter("n > 1").select("gram", "c", "d")).drop("c")
    copied = flipped(these).withColumnsRenamed({"gram": "_gram", "d": "_d"}).join(copies, "_c").filter("gram = _gram AND d = _d").select("a", "b", "first", "until")
    return written(parts, "parts"), copied


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, most_contents: int = MOST_CONTENTS, at_once: int = AT_ONCE) -> DataFrame:
    """id, n_bytes, spans (array of start, end: the removed runs of bytes), kept (binary: the remaining bytes), one row per input row.

    A byte goes if it lies in a string of `length` bytes that starts anywhere else too, in the same text or another one;
    strings are those of the input and don't cross texts. Null and empty texts, and texts shorter than `length`, lose
    nothing. Rows that repeat are places of their own, so both lose all that is long enough. Extra columns are ignored.

    1. A text's windows fall into runs with the same anchor, some hundreds of bytes each, with a hash of the run's bytes.
    2. Runs with equal bytes are counted before the shuffle, and so are found without being compared: copies cost nothing more.
    3. One run of each other content goes to its anchor's group where this has several contents, and is compared there.
       The contents of a group with more than most_contents are runs of windows anew, with further anchors in halves of a
       window, then in eighths and so on down to bytes, and go through 2 and 3 by those.
    4. The runs found are collected by document and cut out of its text.
    """
    keyed = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), row_key(id_col, text_col).alias("_key"))
    # A row that repeats has no single content, but may lend its bytes twice: once is enough.
    texts = keyed.select(F.col("_key.a").alias("a"), F.col("_key.b").alias("b"), F.lit(0).cast("long").alias("base"), F.col("_text").cast("binary").alias("_bytes"))
    found, new_runs, pieces = [], runs(docs, length, id_col, text_col).withColumns({"base": F.lit(0).cast("long"), "n": F.lit(1).cast("long")}), 1
    while True:
        these = written(new_runs, "runs")
        parts, copied = settled(these, texts, length)
        small = F.col("contents") <= most_contents if pieces < length else F.lit(True)
        found += [compared(parts.filter(small), length, at_once), copied]
        hot = parts.filter(~small)
        if hot.isEmpty():
            break
        pieces = min(length, 2 if pieces == 1 else pieces * 4)
        texts, new_runs = hot.select("a", "b", F.col("first").alias("base"), F.col("content").alias("_bytes")), finer(hot, length, pieces)
    cuts = reduce(DataFrame.union, found).groupBy("a", "b").agg(F.collect_set(F.struct("first", "until")).alias("cuts"))
    whole = keyed.select("_id", "_text", F.col("_key.a").alias("a"), F.col("_key.b").alias("b")).join(cuts, ["a", "b"], "left").select(F.col("_id").alias("id"), F.col("_text").alias("text"), "cuts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = as_bytes(batch.column("text"))
            raw = data.tobytes()
            spans, kept = [], []
            for a, b, found in zip(offsets[:-1], offsets[1:], batch.column("cuts").to_pylist()):
                merged: list[list[int]] = []
                for first, until in sorted((c["first"], c["until"]) for c in found or ()):
                    if merged and first <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], until - 1 + length)
                    else:
                        merged.append([first, until - 1 + length])
                edges = [0, *(x for m in merged for x in m), int(b - a)]
                kept.append(b"".join(raw[a + x : a + y] for x, y in zip(edges[::2], edges[1::2])))
                spans.append([{"start": x, "end": y} for x, y in merged])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(offsets)), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    return whole.mapInArrow(cut, f"id {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary").withColumnRenamed("id", id_col)
