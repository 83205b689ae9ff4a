"""Token ids of whole corpora as binary shards, compressed by a grammar and open to random access."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelake.llm import repair
from cuelake.llm.common import as_bytes, slices, written
from cuelake.llm.tokens import TOGETHER, tokenizer_path

#: What closes each document.
END_ID = 2
#: Bytes of text that are encoded at a time.
AT_ONCE = 1 << 23
#: Bytes that the chunks a Python worker keeps may take, with their ids.
KEPT_BYTES = 48 << 20
#: A shard is closed once it holds so many ids; a document is never cut, so a longer one fills a shard of its own.
SHARD_IDS = 1 << 17
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
LETTER = np.isin(np.arange(256), np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", np.uint8))
#: Second bytes, after 0xC3, of the Latin letters with marks; two of that row are signs.
LATIN = (np.arange(256) >= 0x80) & (np.arange(256) <= 0xBF) & ~np.isin(np.arange(256), [0x97, 0xB7])
#: ASCII signs, but for the one that stands inside the names of special tokens.
SIGN = np.isin(np.arange(256), np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{}~", np.uint8))
#: White space beyond ASCII in UTF-8, as numbers of its last two and last three bytes.
SPACE_2 = np.array([0xC285, 0xC2A0])
SPACE_3 = np.array([0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080])


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The texts cut before each run of white space and between letter and sign; and the n + 1 places where each text's chunks begin and end.

    A byte-level tokenizer that splits by its usual pattern never joins what stands on both sides of such a cut: a run of white
    space and the word behind it are split by themselves alone, and a run of letters ends at a sign. White space beyond ASCII
    stays with the run that follows it.
    """
    space = SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    letter = LETTER[data]
    letter[1:] |= (data[:-1] == 0xC3) & LATIN[data[1:]]
    cut[1:-1] = (space[1:] & ~space[:-1]) | (SIGN[data[1:]] & letter[:-1])
    after = np.flatnonzero(cut[:-1])
    after = after[data[after - 1] >= 0x80]  # cuts before white space only
    if len(after):
        wide = lambda k: data[np.maximum(after - k, 0)].astype(np.int64)
        two = wide(2) << 8 | wide(1)
        cut[after[np.isin(two, SPACE_2) | np.isin(wide(3) << 16 | two, SPACE_3)]] = False
    cut[offsets[:-1]] = True
    cut[-1] = False
    starts = np.append(np.flatnonzero(cut), len(data))
    found = pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
    return found, np.searchsorted(starts[:-1], offsets)


@cache
def chunk_ids(path: str | None) -> ChunkIds:
    return ChunkIds(path or tokenizer_path("byte_bpe_50k.json"))


class ChunkIds:
    """Ids of texts under a byte-level tokenizer; each distinct chunk is encoded once, and its ids stay in one buffer.

    Chunks met before are an Arrow array, in which a batch's distinct ones are looked up together. Chunks of one space and a word
    go to the tokenizer many at a time, laid end to end: a token that begins with a space begins the next chunk. Once what is
    kept takes more than most_bytes, it is dropped before the next batch; only speed depends on it.
    """

    WORD = "^ [^\\t-\\r ]+$"

    def __init__(self, path: str, most_bytes: int = KEPT_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True
        self.most_bytes = most_bytes
        self.clear()

    def clear(self) -> None:
        self.known = pa.array([], pa.binary())
        self.ids, self.starts, self.sizes, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), 0

    def held(self) -> int:
        return self.known.nbytes + 12 * len(self.known) + 4 * self.used

    def encoded(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = [e.ids for e in self.tokenizer.encode_batch_fast([p.decode() for p in parts.to_pylist()], add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *(np.array(x, np.uint32) for x in lists)]), np.fromiter(map(len, lists), np.int64, len(lists))

    def encoded_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = as_bytes(words)
        raw, cuts = data.tobytes(), [*offsets[:-1:TOGETHER].tolist(), int(offsets[-1])]
        lines = [raw[a:b].decode() for a, b in zip(cuts, cuts[1:])]
        ids = np.concatenate([np.zeros(0, np.uint32), *(np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False))])
        starts = np.flatnonzero(self.begins[ids])
        if len(starts) != len(words):  # a special token stands in a word, or the file is of another kind
            return self.encoded(words)
        return ids, np.diff(starts, append=len(ids))

    def learn(self, parts: pa.Array) -> None:
        """Keeps the ids of parts, none of them known, behind the others."""
        word = pc.match_substring_regex(parts.cast(pa.string()), self.WORD)
        for some, encode in ((word, self.encoded_words), (pc.invert(word), self.encoded)):
            new, first = parts.filter(some), len(self.known)
            ids, sizes = encode(new)
            while self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            while first + len(new) > len(self.starts):
                self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
            self.ids[self.used : self.used + len(ids)] = ids
            self.starts[first : first + len(new)] = self.used + np.cumsum(sizes) - sizes
            self.sizes[first : first + len(new)] = sizes
            self.used += len(ids)
            self.known = pa.concat_arrays([self.known, new])

    def places(self, parts: pa.Array) -> np.ndarray:
        """Where the distinct parts stand among the known ones; new ones are learnt."""
        found = pc.index_in(parts, self.known)
        if found.null_count:
            new = parts.filter(found.is_null())
            first = len(self.known)
            self.learn(new)
            behind = pc.index_in(new, self.known.slice(first))
            found = pc.replace_with_mask(found, found.is_null(), pc.add(behind, pa.scalar(first, pa.int32())))
        return found.to_numpy()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null: none), and the n + 1 places where each text's begin and end."""
        if self.held() > self.most_bytes:
            self.clear()
        found, bounds = chunks(*as_bytes(texts))
        distinct = found.dictionary_encode()
        places = self.places(distinct.dictionary)[distinct.indices.to_numpy()]
        sizes = self.sizes[places]
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        at = np.repeat((self.starts[places] - ends[:-1]).astype(np.int32), sizes)
        at += np.arange(len(at), dtype=np.int32)
        return self.ids[at], ends[bounds]


def shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, shard_ids: int = SHARD_IDS) -> DataFrame:
    """One row per shard: part, shard, ids (of its documents), n_ids, payload (see repair.py); parts and shards ascend with the documents' ids.

    Each document has its text's ids and END_ID. Rows are dealt out by ranges of the id, so that no order over the whole table
    has to be made in one place; rows that repeat an id stand side by side in the order of the input, and may be dealt to
    several parts; null ids come first, null texts are empty. The payloads hold whole documents, so one never takes more memory
    than shard_ids and its longest document ask for. Extra columns are ignored; an empty table has no shard. tokenizer: path of
    a byte-level tokenizer file on every executor; byte_bpe_50k.json of the public tokenizers where it is None.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = chunk_ids(tokenizer), TaskContext.get().partitionId()
        names: list = []
        held: list[np.ndarray] = []
        starts, number, kind = [0], 0, None

        def close() -> pa.RecordBatch:
            nonlocal names, held, starts, number
            payload = repair.shard(np.concatenate(held), np.array(starts))
            columns = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([names], pa.list_(kind)), pa.array([starts[-1]], pa.int64()), pa.array([payload], pa.binary())]
            names, held, starts, number = [], [], [0], number + 1
            return pa.RecordBatch.from_arrays(columns, ["part", "shard", "ids", "n_ids", "payload"])

        for batch in slices(batches, "text", AT_ONCE):
            kind = batch.schema.field("id").type
            ids, bounds = encoder.encode(batch.column("text"))
            for name, a, b in zip(batch.column("id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                names.append(name)
                held += [ids[a:b], np.array([END_ID], np.uint32)]
                starts.append(starts[-1] + b - a + 1)
                if starts[-1] >= shard_ids:
                    yield close()
        if names:
            yield close()

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("at", F.monotonically_increasing_id())
    return rows.repartitionByRange("id", "at").sortWithinPartitions("id", "at").select("id", "text").mapInArrow(run, f"part int, shard int, ids array<{kind}>, n_ids long, payload binary")


def read_back(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, start, n_tokens, ids_crc32, part, shard, at of every document of a table of shards: read from the payloads alone.

    start counts the ids of all documents before it. The sums before each part come from one row per part, and those before a
    shard from the rows of its part, so no task sees more than these. at: the document's place in its shard.
    """
    light = stored.select("part", "shard", "n_ids")
    parts = light.groupBy("part").agg(F.sum("n_ids").alias("n_part"))
    before_part = parts.select("part", F.coalesce(F.sum("n_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_part"))
    in_part = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = light.join(before_part, "part").select("part", "shard", (F.coalesce(F.sum("n_ids").over(in_part), F.lit(0)) + F.col("before_part")).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                names = batch.column("ids")[row].values
                ids, bounds = repair.Shard.read(batch.column("payload")[row].as_py()).ids()
                raw = memoryview(ids.astype("<u4").tobytes())
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                n = len(sums)
                place = [pa.array(np.full(n, batch.column(c)[row].as_py(), np.int32)) for c in ("part", "shard")]
                columns = [names, pa.array(bounds[:-1]), pa.array(np.diff(bounds)), pa.array(sums, pa.int64()), *place, pa.array(np.arange(n, dtype=np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "own_start", "n_tokens", "ids_crc32", "part", "shard", "at"])

    kind = stored.schema["ids"].dataType.elementType.simpleString()
    out = stored.select("part", "shard", "ids", "payload").mapInArrow(run, f"id {kind}, own_start long, n_tokens long, ids_crc32 long, part int, shard int, at int")
    return out.join(before, ["part", "shard"]).select(F.col("id").alias(id_col), (F.col("before") + F.col("own_start")).alias("start"), "n_tokens", "ids_crc32", "part", "shard", "at")


def token_ranges(stored: DataFrame, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, first, last, tokens for each row of wanted (id, first, last): ids first to last (exclusive) of the document, by random access.

    Only shards that hold a wanted document are read whole, and of each only what the range touches is expanded. Ranges are cut
    to the document; an id that stands in several rows of the corpus gives a row for each; one that stands in none, no row.
    """
    ask = wanted.select(F.col(id_col).alias("id"), F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))
    at = stored.select("part", "shard", F.posexplode("ids").alias("at", "id")).join(ask, "id")
    rows = at.join(stored.select("part", "shard", "payload"), ["part", "shard"]).repartition("part", "shard").sortWithinPartitions("part", "shard").select("part", "shard", "id", "at", "first", "last", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                now = batch.column("part")[row].as_py(), batch.column("shard")[row].as_py()
                if now != key:
                    key, held = now, repair.Shard.read(batch.column("payload")[row].as_py())
                out.append(held.part(*(batch.column(c)[row].as_py() for c in ("at", "first", "last"))).tolist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "first", "last")), pa.array(out, pa.list_(pa.int64()))], ["id", "first", "last", "tokens"])

    kind = stored.schema["ids"].dataType.elementType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, first long, last long, tokens array<long>").withColumnRenamed("id", id_col)


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, shard_ids: int = SHARD_IDS) -> DataFrame:
    """shards() as files in the shared folder, one for each part: written whole or not at all, whatever executor is lost."""
    return written(shards(docs, id_col, text_col, tokenizer, shard_ids), "token-shards")
