"""Ranked lexical search of a set of items in all documents: impacts of matched terms, summed by sorting."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.llm.common import as_bytes, slices, written

#: Terms of items (each item's distinct ones) that are searched in one pass over the documents; more items make more passes. An item is never split.
BLOCK_TERMS = 1 << 20
#: Item-document-impact triples that are sorted at a time.
TRIPLES = 1 << 20
#: Bytes of text that are cut into terms at a time.
AT_ONCE = 1 << 22
#: Groups of tasks whose best documents are ranked first; then those of all groups.
SHARES = 64
#: Documents of a chunk that is sorted: their numbers fill the low digit of the packed keys.
DIGIT = 16

_BYTES = np.arange(256)
UPPER = (_BYTES >= 0x41) & (_BYTES <= 0x5A)
LOWERED = np.where(UPPER, _BYTES + 32, _BYTES).astype(np.uint8)
#: Fixed by the contract: what a term is made of.
IN_TERM = (_BYTES >= 0x80) | UPPER | ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A))


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts (null: none) in order, and the n + 1 places where each text's begin and end."""
    data, offsets = as_bytes(texts)
    inside = IN_TERM[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[1:-1] = inside[1:] & ~inside[:-1]
    begins[offsets[:-1]] = True
    begins = begins[:-1] & inside
    bounds = np.searchsorted(np.flatnonzero(begins), offsets)
    kept = LOWERED[data[inside]]
    starts = np.append(np.flatnonzero(begins[inside]), len(kept)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(kept)]), bounds


def radix_order(keys: np.ndarray, sorted_bits: int = 0) -> np.ndarray:
    """The order that sorts keys (not negative), digit by digit of 16 bits from the lowest; the lowest sorted_bits already ascend."""
    order = np.arange(len(keys))
    for shift in range(sorted_bits, int(keys.max(initial=0)).bit_length(), 16):
        digit = (keys >> shift).astype(np.uint16)
        order = order[np.argsort(digit[order], kind="stable")]
    return order


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """item, term: the distinct terms of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", AT_ONCE):
            terms, bounds = terms_of(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(np.repeat(np.arange(batch.num_rows), np.diff(bounds)))), terms], ["item", "term"])

    kind = items.schema[item_col].dataType.simpleString()
    return items.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).mapInArrow(run, f"item {kind}, term binary").distinct()


@dataclass
class Block:
    """Items searched together: `terms` sorted, and for each the places in `items` that hold it, from starts[t] to starts[t + 1]."""

    items: pa.Array
    terms: pa.Array
    starts: np.ndarray
    holders: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> Block:
        items, terms = (table.column(c).combine_chunks() for c in ("item", "term"))
        items = items.dictionary_encode(null_encoding="encode")
        known = terms.unique().sort()
        term = pc.index_in(terms, known).to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(term, kind="stable")
        starts = np.searchsorted(term[order], np.arange(len(known) + 1))
        return cls(items.dictionary, known, starts, items.indices.to_numpy(zero_copy_only=False).astype(np.int64)[order])


def postings(docs: DataFrame, block, id_col: str, text_col: str) -> DataFrame:
    """id, n (all terms with repeats), terms and tfs (numbers of the block's terms in it, ascending, and how often each occurs): one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = block.value.terms
        for batch in slices(batches, "text", AT_ONCE):
            terms, bounds = terms_of(batch.column("text"))
            n = np.diff(bounds)
            number = pc.fill_null(pc.index_in(terms, known), -1).to_numpy()
            matched = np.flatnonzero(number >= 0)
            keys = np.sort(np.repeat(np.arange(len(n)), n)[matched] * len(known) + number[matched])
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            offsets = np.searchsorted(keys[starts], np.arange(len(n) + 1) * len(known)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.astype(np.int32))) for x in (keys[starts] % max(len(known), 1), np.diff(starts, append=len(keys)))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n.astype(np.int64)), *lists], ["id", "n", "terms", "tfs"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n long, terms array<int>, tfs array<int>")


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)


class Best:
    """The k best documents of each item so far, in heaps whose first entry is the worst one kept."""

    def __init__(self, items: int, k: int):
        self.k, self.heaps, self.least = k, {}, np.ones(items, np.int64)

    def add(self, items: np.ndarray, scores: np.ndarray, ids: np.ndarray, has_id: np.ndarray) -> None:
        """ids that are missing come last among equal scores."""
        some = np.flatnonzero(scores >= self.least[items])
        for item, entry in zip(items[some].tolist(), zip(scores[some].tolist(), has_id[some].tolist(), (-ids[some]).tolist())):
            heap = self.heaps.setdefault(item, [])
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.k:
                self.least[item] = heap[0][0]

    def rows(self) -> list[tuple[int, int | None, int]]:
        return [(item, -i if known else None, score) for item, heap in self.heaps.items() for score, known, i in heap]


def accumulated(rows: DataFrame, block, w, n_docs: int, n_terms: int, k: int, triples: int) -> DataFrame:
    """part, item, id, score: of each task's documents the k best ones for each item of the block.

    A document lies in one task whole, so its sums are complete there. Its impacts meet those of other documents as (item,
    document, impact): the packed keys are put in order by a radix sort, and each run of equal keys is one sum.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weight, part = block.value, w.value, TaskContext.get().partitionId()
        best, width = Best(len(own.items), k), np.diff(own.starts)
        for batch in batches:
            lists = batch.column("terms")
            offsets = np.asarray(lists.offsets).astype(np.int64)
            terms, tfs = lists.flatten().to_numpy(), batch.column("tfs").flatten().to_numpy().astype(np.int64)
            sizes = np.diff(offsets)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            m = 100 - 50 + (50 * batch.column("n").to_numpy() * n_docs) // max(n_terms, 1)
            impact = weight[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m[doc]))
            ids, has_id = pc.fill_null(batch.column("id"), 0).to_numpy(), batch.column("id").is_valid().to_numpy(zero_copy_only=False)
            made = np.concatenate([[0], np.cumsum(width[terms])])[offsets - offsets[0]]
            first = 0
            while first < len(sizes):
                end = min(max(first + 1, int(np.searchsorted(made, made[first] + triples, "right")) - 1), first + (1 << DIGIT))
                a, b = offsets[first] - offsets[0], offsets[end] - offsets[0]
                each = width[terms[a:b]]
                ends = np.cumsum(each)
                places = np.repeat(own.starts[terms[a:b]] - (ends - each), each) + np.arange(int(ends[-1]) if len(ends) else 0)
                keys = own.holders[places] << DIGIT | np.repeat(doc[a:b] - first, each)
                if len(keys):
                    order = radix_order(keys, DIGIT)
                    keys = keys[order]
                    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                    scores = np.add.reduceat(np.repeat(impact[a:b], each)[order], starts)
                    of = (keys[starts] & ((1 << DIGIT) - 1)) + first
                    best.add(keys[starts] >> DIGIT, scores, ids[of], has_id[of])
                first = end
        if out := best.rows():
            columns = list(zip(*out))
            item = own.items.take(pa.array(columns[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(out), pa.int32()), item, pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["part", "item", "id", "score"])

    return rows.select("id", "n", "terms", "tfs").mapInArrow(run, f"part int, item {_kind(block.value.items.type)}, id long, score long")


def _kind(of: pa.DataType) -> str:
    from pyspark.sql.pandas.types import from_arrow_type

    return from_arrow_type(of).simpleString()


def ranked(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_terms: int = BLOCK_TERMS, triples: int = TRIPLES) -> DataFrame:
    """item, rank (from 1), id, score: for each item the k documents with the highest score above 0, equal scores by ascending id.

    Terms, weights and scores are as the contract of op11 says; statistics are those of all documents. Items are searched in
    blocks of about block_terms distinct terms, each block against all documents: its terms are what is broadcast, so their
    size is bounded however many items there are. The documents' texts are never shuffled: one pass writes what they hold of
    the block's terms, a second one sums impacts in bounded chunks and keeps k documents per item and task, which are ranked
    in two steps, so that no task meets the rows of all the others.

    Ids of documents are whole numbers; null ones come last. Rows that repeat an id are documents of their own. Rows that repeat
    an item's id, null included, are one item with the terms of all its texts. Null and empty texts have no terms; an item
    without terms, or whose terms no document holds, has no row. Extra columns are ignored; empty tables give no rows.
    """
    spark = docs.sparkSession
    terms = written(item_terms(items, item_col, item_text_col), "item-terms")
    blocks = -(-terms.count() // block_terms)
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id")))
    out = []
    for b in range(blocks):
        of_block: Column = F.pmod(F.xxhash64("item"), F.lit(blocks)) == b
        table = terms.filter(of_block).toArrow()
        if not table.num_rows:
            continue
        own = Block.of(table)
        block = spark.sparkContext.broadcast(own)
        found = written(postings(docs, block, id_col, text_col), "postings")
        n_docs, n_terms = found.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        counts = found.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toArrow()
        df = np.zeros(len(own.terms), np.int64)
        df[counts.column("t").to_numpy()] = counts.column("df").to_numpy()
        best = accumulated(found, block, spark.sparkContext.broadcast(weights(n_docs, df)), n_docs, n_terms, k, triples)
        near = best.withColumn("share", F.pmod("part", F.lit(SHARES))).withColumn("rank", rank("item", "share")).filter(F.col("rank") <= k)
        out.append(near.withColumn("rank", rank("item")).filter(F.col("rank") <= k).select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score"))
    if not out:
        schema = f"{item_col} {items.schema[item_col].dataType.simpleString()}, rank int, {id_col} long, score long"
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.union, out)
