"""Hierarchical packing of tokenized documents into windows of several lengths."""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import slices
from cuelake.llm.tokens import word_ids

#: The longest window, and the context-size tiers that documents are routed to.
WINDOW, TIERS = 4096, (512, 1024, 2048, 4096)
END_ID = 2
#: Tokens of a step group: windows of all tiers are dealt so that groups of a batch have about as many.
STEP_TOKENS = 16 * WINDOW
#: Bytes of text whose documents are packed together; what doesn't fill a window goes on to the next batch.
BATCH_BYTES = 16 << 20


@dataclass(order=True)
class Part:
    """Tokens start to start + length of a document that are still to be placed."""

    length: int
    number: int
    start: int = field(compare=False)


def tier_of(length: int) -> int:
    return next(t for t in TIERS if length <= t)


def pack(lengths: list[int], last: bool = True) -> tuple[list[tuple[int, list[Part]]], list[Part]]:
    """Windows (size, parts) that are full to the last token, and the parts that are left for a later batch (none if last).

    A document's full windows of 4096 come first. What remains of it goes to the smallest tier that holds it. From the longest
    tier down, each document opens a window of its tier; the gap takes the longest whole documents of shorter tiers that fit,
    and in the end the head of one more, whose tail stays in its pool. When the pools run dry, the rest is laid end to end and
    closed with windows whose sizes are powers of two, so no window needs padding.
    """
    windows: list[tuple[int, list[Part]]] = []
    pools: dict[int, list[Part]] = {t: [] for t in TIERS}
    for number, n in enumerate(lengths):
        full = n // WINDOW
        windows += [(WINDOW, [Part(WINDOW, number, k * WINDOW)]) for k in range(full)]
        if n % WINDOW:
            pools[tier_of(n % WINDOW)].append(Part(n % WINDOW, number, full * WINDOW))
    for pool in pools.values():
        pool.sort()
    open_ended: list[Part] = []
    for tier in reversed(TIERS):
        while pools[tier]:
            parts = [pools[tier].pop()]
            gap = tier - parts[0].length
            for shorter in [t for t in reversed(TIERS) if t < tier or t == TIERS[0]]:
                pool = pools[shorter]
                while gap and (at := bisect_left(pool, Part(gap + 1, -1, 0))):
                    parts.append(pool.pop(at - 1))
                    gap -= parts[-1].length
            if gap and (pool := next((pools[t] for t in TIERS if pools[t] and (t < tier or t == TIERS[0])), None)):
                cut = pool.pop()
                parts.append(Part(gap, cut.number, cut.start))
                insort(pools[tier_of(cut.length - gap)], Part(cut.length - gap, cut.number, cut.start + gap))
                gap = 0
            if gap:
                open_ended += parts
            else:
                windows.append((tier, parts))
    # What is left opens windows of 4096, each filled to the end by cutting.
    parts, space, left = [], WINDOW, sum(p.length for p in open_ended)
    if not last and left < WINDOW:
        return windows, open_ended
    size = WINDOW if left >= WINDOW else 1 << max(left.bit_length() - 1, 0)
    space = size
    for k, p in enumerate(open_ended):
        while p.length:
            take = min(space, p.length)
            parts.append(Part(take, p.number, p.start))
            p = Part(p.length - take, p.number, p.start + take)
            space, left = space - take, left - take
            if not space:
                windows.append((size, parts))
                if not last and left < WINDOW:
                    return windows, [*([p] if p.length else []), *open_ended[k + 1 :]]
                size = WINDOW if left >= WINDOW else 1 << max(left.bit_length() - 1, 0)
                parts, space = [], size
    return windows, []


def step_groups(sizes: list[int]) -> list[int]:
    """A step group for each window: the longest first, each to the group with the fewest tokens so far."""
    groups = [(0, g) for g in range(max(1, -(-sum(sizes) // STEP_TOKENS)))]
    out = [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        tokens, g = heapq.heappop(groups)
        out[k] = g
        heapq.heappush(groups, (tokens + sizes[k], g))
    return out


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens, step_group.

    A document's ids are those of its text and END_ID; null and empty texts have END_ID alone. Every id lies in one piece, the
    pieces of a sequence lie end to end, and each sequence has a power of two of tokens, 4096 at most, so padding is nought.
    Rows that repeat an id are packed as documents of their own; extra columns are ignored; an empty table gives no row.

    Each task tokenizes and packs the documents of its own partition in batches of BATCH_BYTES, so nothing is shuffled and
    memory is bounded; fewer than 4096 tokens go from one batch to the next. Sequence and group ids hold the partition's
    number, so a task that runs again gives the same ones. tokenizer: path of a tokenizer file that drops white space, on
    every executor; word_bpe_49k.json of the public tokenizers where it is None.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(tokenizer)
        first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        sequence = group = 0
        held: list[tuple] = []  # (id, ids, place of the first, doc_tokens, whole)
        fresh: list[tuple] = []
        size, kind = 0, None

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, fresh, size, sequence, group
            every = held + fresh
            windows, left = pack([len(x[1]) for x in every], last)
            groups = step_groups([s for s, _ in windows])
            rows: list[tuple] = []
            for (tokens, parts), g in zip(windows, groups):
                offset = 0
                for p in parts:
                    name, data, start, n = every[p.number]
                    rows.append((name, start + p.start, p.length, zlib.crc32(data[p.start : p.start + p.length].astype("<u4")), n, first + sequence, offset, tokens, first + group + g))
                    offset += p.length
                sequence += 1
            group += max(groups, default=-1) + 1
            held = [(every[p.number][0], every[p.number][1][p.start : p.start + p.length].copy(), every[p.number][2] + p.start, every[p.number][3]) for p in left]
            fresh, size = [], 0
            if rows:
                names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "step_group"]
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], names)

        for batch in slices(batches, "text"):
            kind = batch.schema.field("id").type
            ids, bounds = encoder.encode(batch.column("text"))
            fresh += [(name, np.append(ids[a:b], np.uint32(END_ID)), 0, int(b - a) + 1) for name, a, b in zip(batch.column("id").to_pylist(), bounds[:-1], bounds[1:])]
            size += batch.column("text").nbytes
            if size >= BATCH_BYTES:
                yield from flush(False)
        if fresh or held:
            yield from flush(True)

    kind = docs.schema[id_col].dataType.simpleString()
    fields = ", ".join(f"{c} long" for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "step_group"))
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, {fields}").withColumnRenamed("id", id_col)
