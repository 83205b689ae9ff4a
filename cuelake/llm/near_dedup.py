"""Near-duplicate documents: MinHash bands, odd sketches, and a check of every candidate on its full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.llm import shingles
from cuelake.llm.common import as_bytes, row_key, slices, written
from cuelake.llm.components import connected

#: Members of a block; larger buckets are compared block by block, so that a task holds two blocks at most.
BLOCK = 768
#: Members whose texts one task compares with those of the same lead.
SHARE = 512
WORDS = shingles.SKETCH_BITS // 64


def keyed(docs: DataFrame, *columns: Column | str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key_a and key_b, the two halves of row_key, and the given columns of docs (all of them, if none is given)."""
    key = row_key(id_col, text_col)
    return docs.select(key["a"].alias("key_a"), key["b"].alias("key_b"), *(columns or ["*"]))


def signatures(docs: DataFrame, k: int, rows: int, bands: int, id_col: str, text_col: str) -> DataFrame:
    """id, key_a and key_b (row_key), n_shingles, seq_a and seq_b (a hash of all words in order), bands (keys) and sketch; the last two are empty without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = as_bytes(batch.column("text"))
            raw = data.tobytes()
            texts = [shingles.normalised(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            hashes, bounds = shingles.shingle_sets(texts, k)
            counts = np.diff(bounds)
            full = counts > 0
            keys, sketches = np.zeros((0, bands), np.int64), np.zeros((0, WORDS), np.int64)
            if full.any():
                minima = shingles.min_samples(hashes, np.append(bounds[:-1][full], bounds[-1]), rows * bands)
                keys, sketches = shingles.band_keys(minima, rows), shingles.odd_sketches(minima)
            lists = lambda values: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(full * values.shape[1])]).astype(np.int32)), pa.array(values.ravel()))
            seq = [shingles.sequence_hash(t) for t in texts]
            columns = [pa.array(counts), pa.array([s[0] for s in seq], pa.int64()), pa.array([s[1] for s in seq], pa.int64()), lists(keys), lists(sketches)]
            own = [batch.column(c) for c in ("id", "key_a", "key_b")]
            yield pa.RecordBatch.from_arrays([*own, *columns], ["id", "key_a", "key_b", "n_shingles", "seq_a", "seq_b", "bands", "sketch"])

    source = keyed(docs, F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), id_col=id_col, text_col=text_col)
    return source.mapInArrow(run, "id long, key_a long, key_b long, n_shingles long, seq_a long, seq_b long, bands array<long>, sketch array<long>")


def near(n_a: Column, n_b: Column, sketch_a: Column, sketch_b: Column, percent: int, most: int) -> Column:
    """Whether sizes allow the similarity, and the sketches differ in `most` bits at most."""
    differing = sum((F.bit_count(sketch_a[i].bitwiseXOR(sketch_b[i])) for i in range(WORDS)), F.lit(0))
    return (F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent) & (differing <= most)


def linked(hashes_a: np.ndarray, hashes_b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(hashes_a, hashes_b, assume_unique=True))
    return 100 * common >= percent * (len(hashes_a) + len(hashes_b) - common)


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are as similar as asked for. A lead's partners are shared out among tasks, with a copy of its text to each."""
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / SHARE).alias("_shares"))
    dealt = pairs.join(shares, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("_shares")).alias("share"))
    leads = dealt.select("a", "share").distinct().join(texts, F.col("a") == F.col("id")).select("a", "share", F.lit(None).cast("long").alias("b"), "text")
    rows = leads.unionByName(dealt.join(texts, F.col("b") == F.col("id")).select("a", "share", "b", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, of_lead = None, np.zeros(0, np.uint64)
        for batch in slices(batches, "text"):
            data, offsets = as_bytes(batch.column("text"))
            raw = data.tobytes()
            hashes, bounds = shingles.shingle_sets([shingles.normalised(raw[x:y]) for x, y in zip(offsets[:-1], offsets[1:])], k)
            out = []
            for i, (a, share, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "share", "b")))):
                own = hashes[bounds[i] : bounds[i + 1]]
                if b is None:
                    if lead != (a, share):
                        lead, of_lead = (a, share), own.copy()
                elif lead == (a, share) and linked(of_lead, own, percent):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

    return rows.repartition("a", "share").sortWithinPartitions("a", "share", F.col("b").asc_nulls_first()).mapInArrow(run, "a long, b long")


def may_link(sizes: np.ndarray, sketches: np.ndarray, sides: np.ndarray, groups: np.ndarray, percent: int, most: int) -> np.ndarray:
    """A matrix that tells which members i < j of a block can be linked by their sizes and sketches, are of different groups and, where there are two sides, of both."""
    two = len(np.unique(sides)) > 1
    may = np.zeros((len(sizes), len(sizes)), bool)
    for i in range(len(sizes)):
        other = (groups != groups[i]) & (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i]))
        if two:
            other &= sides != sides[i]
        other[: i + 1] = False
        at = np.flatnonzero(other)
        may[i, at] = np.bitwise_count((sketches[at] ^ sketches[i]).view(np.uint64)).sum(axis=1) <= most
    return may


def block_links(sets: list[np.ndarray], sketches: np.ndarray, sides: np.ndarray, groups: list[int], percent: int, most: int) -> list[tuple[int, int]]:
    """Links (places in sets) that join different groups and aren't implied by links before them; where there are two sides, only across them.

    The sketches choose the members that have any candidate, then one matrix product gives the sizes of all intersections.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    group_of = np.unique(groups, return_inverse=True)[1]
    may = may_link(sizes, sketches, sides, group_of, percent, most)
    used = np.flatnonzero(may.any(axis=0) | may.any(axis=1))
    if not len(used):
        return []
    every, columns = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True)
    rows = np.repeat(np.arange(len(used)), sizes[used])
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    common = np.zeros((len(used), len(used)), np.float32)
    for first in range(0, len(every), 4096):
        a, b = np.searchsorted(columns, [first, first + 4096])
        part = np.zeros((len(used), min(4096, len(every) - first)), np.float32)
        part[rows[a:b], columns[a:b] - first] = 1
        common += part @ part.T
    total = sizes[used][:, None] + sizes[used][None, :] - common
    found = np.argwhere(may[np.ix_(used, used)] & (100 * common.astype(np.float64) >= percent * total))
    parent = list(range(group_of.max() + 1))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in used[found]:
        x, y = root(group_of[i]), root(group_of[j])
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((int(i), int(j)))
    return out


def by_block(rows: DataFrame, columns: list[str], of_block, schema: str, texts: tuple[int, str] | None = None) -> DataFrame:
    """of_block over the members of each (bucket, i, j), which one task holds: a list of dicts, with `sets` where texts gives k; what it returns are rows of schema."""
    names = [f.strip().split(" ")[0] for f in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if held and (out := of_block(held)):
                yield pa.RecordBatch.from_pydict({n: [x[c] for x in out] for c, n in enumerate(names)})

        for batch in slices(batches, texts[1]) if texts else batches:
            if texts:
                data, offsets = as_bytes(batch.column(texts[1]))
                raw = data.tobytes()
                hashes, bounds = shingles.shingle_sets([shingles.normalised(raw[x:y]) for x, y in zip(offsets[:-1], offsets[1:])], texts[0])
            for r, row in enumerate(batch.select(columns).to_pylist()):
                if (now := (row["bucket"], row["i"], row["j"])) != key:
                    yield from done()
                    key, held = now, []
                if texts:
                    row["set"] = hashes[bounds[r] : bounds[r + 1]].copy()
                held.append(row)
        yield from done()

    return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(run, schema)


def across(members: DataFrame, texts: DataFrame, k: int, percent: int, most: int, block: int) -> DataFrame:
    """Links (a, b) between members of a bucket that belong to different components; members: bucket, n, id, component, n_shingles, sketch.

    A bucket's largest component, if it holds most of the members, is never compared with itself, so a large group of copies
    costs a few strangers times its size, not its square: its members and the others are cut into blocks of their own by a hash
    of the id, and each pair of blocks is one group, but for pairs of the largest component's. Only sketches go to the pairs of
    blocks; texts go where their sketch has a partner.
    """
    flipped = lambda df: df.withColumn("_k", F.col("bucket").bitwiseXOR(F.lit(1)))
    sizes = members.groupBy("bucket", "component").agg(F.count("*").alias("_of"))
    largest = sizes.groupBy("bucket").agg(F.max(F.struct("_of", "component")).alias("_l")).select("bucket", F.col("_l._of").alias("_most"), F.col("_l.component").alias("_main"))
    sized = flipped(members).join(flipped(largest).drop("bucket"), "_k").drop("_k")
    cut = F.col("_most") * 2 > F.col("n")
    main = cut & (F.col("component") == F.col("_main"))
    others = F.ceil(F.when(cut, F.col("n") - F.col("_most")).otherwise(F.col("n")) / block)
    own = F.when(cut, F.ceil(F.col("_most") / block)).otherwise(0)
    hashed = F.xxhash64("id")
    mine = F.when(main, others + F.pmod(hashed, F.greatest(own, F.lit(1)))).otherwise(F.pmod(hashed, F.greatest(others, F.lit(1))))
    last = F.when(main, others - 1).otherwise(others + own - 1)
    placed = sized.withColumn("_mine", mine).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    columns = ["bucket", "i", "j", "side", "id", "component", "n_shingles", "sketch"]
    rows = placed.select("bucket", F.least("_mine", "_other").alias("i"), F.greatest("_mine", "_other").alias("j"), F.col("_mine").alias("side"), *columns[4:])

    def arrays(held: list[dict], *names: str) -> list[np.ndarray]:
        return [np.array([row[n] for row in held], np.int64) for n in names]

    def likely(held: list[dict]) -> list[tuple]:
        sizes, sketches, sides, components = arrays(held, "n_shingles", "sketch", "side", "component")
        may = may_link(sizes, sketches, sides, components, percent, most)
        return [tuple(held[x][c] for c in columns) for x in np.flatnonzero(may.any(axis=0) | may.any(axis=1))]

    def links(held: list[dict]) -> list[tuple]:
        sketches, sides, components = arrays(held, "sketch", "side", "component")
        return [(held[x]["id"], held[y]["id"]) for x, y in block_links([row["set"] for row in held], sketches, sides, components, percent, most)]

    kinds = ", ".join(f"{c} array<long>" if c == "sketch" else f"{c} long" for c in columns)
    chosen = by_block(rows, columns, likely, kinds)
    return by_block(chosen.join(texts, "id"), columns, links, "a long, b long", (k, "text"))


def classes_linked(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, rows: int | None, block: int, by_id: bool) -> tuple[DataFrame, DataFrame]:
    """The signatures, and for each class of texts with the same words (seq_a, seq_b) its component and component_id, the smallest id in it.

    by_id: the classes of an id that has several texts are linked too.

    1. Texts with the same words form a class and go on as one document, so exact copies cost nothing. Classes are numbered
       in the order of their smallest ids; an id may be the smallest one of several classes.
    2. MinHash samples are folded into band keys (a pair at the threshold misses all bands once in 10^7) and an odd sketch.
    3. In each band bucket every member is paired with the first and the last one, which doesn't grow with its square. Pairs
       whose sketches differ too much (a pair at the threshold: once in 10^9) go; the rest is confirmed on full sets.
    4. Buckets whose members these links don't join are compared in full across the components, in blocks of bounded size (a
       bucket's main component only with the others), and only links that join components leave a block. So every pair of a
       bucket is joined or compared.
    """
    rows = rows or (5 if percent >= 85 else 4)
    bands = shingles.bands_for(percent / 100, rows)
    most = 2 * shingles.most_differences(percent / 100, rows * bands)
    sig = written(signatures(docs, k, rows, bands, id_col, text_col), "signatures")
    live = sig.filter("n_shingles > 0 AND id IS NOT NULL")
    smallest = live.groupBy("seq_a", "seq_b").agg(F.min("id").alias("first_id"))
    classes = written(smallest.orderBy("first_id", "seq_a", "seq_b").withColumn("rep", F.monotonically_increasing_id()), "classes")
    reps = live.join(classes.withColumnRenamed("first_id", "id"), ["id", "seq_a", "seq_b"]).dropDuplicates(["id", "seq_a", "seq_b"])
    reps = written(reps.select(F.col("rep").alias("id"), "key_a", "key_b", "n_shingles", "bands", "sketch"), "reps")
    buckets = reps.select("id", F.explode("bands").alias("bucket"))
    sized = buckets.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n")).filter("low < high")
    # Another key than the one the counts are dealt by: both sides are shuffled anew, and a hot bucket's rows can be split.
    flipped = lambda df: df.withColumn("_k", F.col("bucket").bitwiseXOR(F.lit(1)))
    members = written(flipped(buckets).join(flipped(sized).drop("bucket"), "_k").drop("_k"), "members")
    wanted = reps.select("id", "key_a", "key_b").join(members.select("id").distinct(), "id", "left_semi")
    texts = keyed(docs, F.coalesce(F.col(text_col), F.lit("")).alias("text"), id_col=id_col, text_col=text_col)
    texts = written(texts.join(wanted, ["key_a", "key_b"]).dropDuplicates(["key_a", "key_b", "id"]).select("id", "text"), "texts")
    sketches = reps.select("id", "n_shingles", "sketch")
    pairs = members.filter("id > low").select(F.col("low").alias("a"), F.col("id").alias("b")).union(members.filter("id < high AND id > low").select(F.col("high").alias("a"), F.col("id").alias("b"))).distinct()
    side = lambda x: sketches.select(F.col("id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    likely = pairs.join(side("a"), "a").join(side("b"), "b").filter(near(F.col("n_a"), F.col("n_b"), F.col("s_a"), F.col("s_b"), percent, most)).select("a", "b")
    first = written(connected(confirmed(written(likely, "pairs"), texts, k, percent)), "components")
    # Buckets of up to three members have had all their pairs.
    named = members.filter("n > 3").select("bucket", "n", "id").join(first, "id", "left").withColumn("component", F.coalesce("component", "id"))
    split = named.groupBy("bucket").agg(F.min("component").alias("c"), F.max("component").alias("d")).filter("c < d")
    open_ = written(flipped(named).join(flipped(split).select("_k"), "_k", "left_semi").drop("_k").join(sketches, "id"), "open")
    more = across(open_, texts, k, percent, most, block)
    if by_id:
        several = live.groupBy("id").agg(*(f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("seq_a", "seq_b"))).filter("min_seq_a < max_seq_a OR min_seq_b < max_seq_b").select("id")
        of_id = live.join(several, "id", "left_semi").select("id", "seq_a", "seq_b").distinct().join(classes.drop("first_id"), ["seq_a", "seq_b"])
        more = more.union(of_id.join(of_id.groupBy("id").agg(F.min("rep").alias("a")), "id").filter("a < rep").select("a", F.col("rep").alias("b")))
    joined = more.join(first.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left").join(first.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left")
    second = connected(joined.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    every = first.unionByName(second.select("id", F.col("id").alias("component")).join(first, "id", "left_anti"))
    final = every.join(second.select(F.col("id").alias("component"), F.col("component").alias("_top")), "component", "left").select(F.col("id").alias("rep"), F.coalesce("_top", "component").alias("component"))
    final = final.join(classes.select(F.col("rep").alias("component"), F.col("first_id").alias("component_id")), "component")
    of_class = classes.join(final, "rep", "left").select("seq_a", "seq_b", F.coalesce("component", "rep").alias("component"), F.coalesce("component_id", "first_id").alias("component_id"))
    return sig.drop("bands", "sketch"), of_class


def _with_components(sig: DataFrame, of_class: DataFrame) -> DataFrame:
    """sig with component and component_id, both null for rows without words or id."""
    right = of_class.select(F.col("seq_a").alias("_a"), F.col("seq_b").alias("_b"), "component", "component_id")
    return sig.join(right, (F.col("seq_a") == F.col("_a")) & (F.col("seq_b") == F.col("_b")) & (F.col("n_shingles") > 0) & F.col("id").isNotNull(), "left").drop("_a", "_b")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, rows: int | None = None, block: int = BLOCK) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Words lie between white space, A-Z in lower case. A text's set holds its distinct k-word shingles; one with fewer words
    has all its words as one shingle. Texts are linked when 100 * intersection >= percent * union; a component is what links
    reach, named by its smallest id, and the row with this id is kept.

    Texts without words, and rows with a null id, are linked with nothing. Rows that repeat an id count as one document with
    the links of all its texts, and share its component. Ids are whole numbers; extra columns are ignored.
    """
    sig, of_class = classes_linked(docs, id_col, text_col, k, percent, rows, block, by_id=True)
    wordless = (F.col("n_shingles") == 0) & F.col("id").isNotNull()
    mixed = sig.filter("id IS NOT NULL").groupBy("id").agg(F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high")).filter("low = 0 AND high > 0").select("id")
    of_mixed = _with_components(sig.filter("n_shingles > 0").join(mixed, "id", "left_semi"), of_class).select("id", "component_id").distinct()
    out = _with_components(sig.filter(~F.coalesce(wordless, F.lit(False))), of_class).select("id", "n_shingles", "component_id")
    out = out.unionByName(sig.filter(wordless).join(of_mixed, "id", "left").select("id", "n_shingles", "component_id"))
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, rows: int | None = None, block: int = BLOCK) -> DataFrame:
    """key_a, key_b (see keyed) of the rows that stay: one of each component.

    Links are near_dedup's, but each row counts with its own text only, whatever rows share its id: the first one of a component
    is that with the smallest id, then the smallest key. Rows without words or id are linked with nothing and stay. Rows that
    repeat id and text have one key.
    """
    found = _with_components(*classes_linked(docs, id_col, text_col, k, percent, rows, block, by_id=False))
    firsts = found.filter("id = component_id").groupBy("component").agg(F.min(F.struct("key_a", "key_b")).alias("_k")).select("_k.key_a", "_k.key_b")
    return firsts.union(found.filter("component IS NULL").select("key_a", "key_b").distinct())
