"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import slices

ORDERS = (1, 2, 3)
BUCKETS = 1 << 14
#: Most labelled documents that training reads; those with the smallest hash of their id.
MAX_TRAINING_DOCUMENTS = 4000
UNDETERMINED = "und"
#: Bytes of text that are scored at a time; numpy takes about 50 bytes for each of them.
AT_ONCE = 1 << 18
LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray  # (BUCKETS, languages)


def held_out(id_col: str) -> Column:
    """Whether a document is for testing only: crc32 of its id as text leaves 2 when divided by 4. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def ngram_buckets(texts: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every n-gram that starts at each code point, as (order, place), and the place where each text starts. An n-gram that would leave its text has bucket -1."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(t) for t in lowered], np.int64)
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(points))  # code points up to the text's end
    out = np.full((len(ORDERS), len(points)), -1, np.int32)
    for row, n in enumerate(ORDERS):
        if len(points) < n:
            continue
        h = np.full(len(points) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h ^ points[k : len(points) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        got = (h >> np.uint64(17)).astype(np.int64) % buckets
        out[row, : len(got)] = np.where(left[: len(got)] >= n, got, -1)
    return out, ends - sizes


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = MAX_TRAINING_DOCUMENTS, buckets: int = BUCKETS) -> LanguageModel:
    """A model from the rows that are not held out and have an id, a text and a language: at most `most` of them, by the smallest hash of their id; of rows that share an id the first by text.

    Counts are made in tasks and summed by (language, bucket); only this table, bounded by languages times buckets, reaches
    the driver. Without any labelled row the model knows no language and predicts `und` for all.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(~held_out("_id") & F.col("text").isNotNull() & F.col("lang").isNotNull())
    chosen = rows.select("_id").distinct().orderBy(F.xxhash64("_id"), "_id").limit(most)
    sample = rows.join(F.broadcast(chosen), "_id", "left_semi").groupBy("_id").agg(F.min(F.struct("text", "lang")).alias("_row")).select("_row.text", "_row.lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        n_docs: dict[str, int] = {}
        for batch in slices(batches, "text", AT_ONCE):
            texts, names = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for name in set(names):
                found, _ = ngram_buckets([t for t, x in zip(texts, names) if x == name], buckets)
                counts[name] = counts.get(name, 0) + np.bincount(found[found >= 0], minlength=buckets)
                n_docs[name] = n_docs.get(name, 0) + names.count(name)
        for name, c in counts.items():
            used = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * (len(used) + 1)), pa.array(np.append(used, -1)), pa.array(np.append(c[used], n_docs[name]))], ["lang", "bucket", "n"])

    table = sample.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = np.array(table.column("lang").to_pylist(), dtype=object)
    bucket, n = table.column("bucket").to_numpy(), table.column("n").to_numpy()
    languages = sorted(set(names))
    prior, prob = np.zeros(len(languages)), np.zeros((buckets, len(languages)))
    for k, name in enumerate(languages):
        of = names == name
        inside = of & (bucket >= 0)
        prior[k] = n[of & (bucket < 0)].sum()
        prob[bucket[inside], k] = n[inside]
    prob = np.log((prob + 0.5) / (prob + 0.5).sum(axis=0, keepdims=True))
    return LanguageModel(languages, np.log(prior / max(prior.sum(), 1)), prob.astype(np.float32))


def scored(texts: list[str], model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """Index of the most probable language of each text, and its posterior probability."""
    buckets, starts = ngram_buckets(texts, len(model.log_prob))
    total = np.tile(model.log_prior, (len(texts), 1))
    full = np.array([len(t) > 0 for t in texts])
    if buckets.shape[1]:
        at = np.minimum(starts, buckets.shape[1] - 1)
        padded = np.vstack([model.log_prob, np.zeros((1, model.log_prob.shape[1]), np.float32)])  # the row that -1 takes
        for k in range(len(model.languages)):
            column = np.ascontiguousarray(padded[:, k])
            each = sum(column[b] for b in buckets)
            total[full, k] += np.add.reduceat(each, at[full], dtype=np.float64)
    total -= total.max(axis=1, keepdims=True)
    posterior = np.exp(total)
    posterior /= posterior.sum(axis=1, keepdims=True)
    best = posterior.argmax(axis=1)
    return best, posterior[np.arange(len(texts)), best]


def language_id(docs: DataFrame, model: LanguageModel | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: tuple[str, ...] = ()) -> DataFrame:
    """id, held_out, lang_pred, score per row, and the columns in carry: the language of the whole text and its posterior probability.

    Without a model, one is trained from the table itself by train(). A text that is null or has no letter gives `und` with
    score 0. Equal posteriors go to the language first by name. Rows that repeat give repeated rows; extra columns are
    ignored unless carried. The model (languages times buckets) is broadcast; its size doesn't depend on the table's.
    """
    model = model or train(docs, id_col, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, "_text", AT_ONCE):
            texts = pc.fill_null(batch.column("_text"), "").to_pylist()
            letters = np.array([LETTER.search(t) is not None for t in texts]) & (len(model.languages) > 0)
            names, scores = np.full(len(texts), UNDETERMINED, dtype=object), np.zeros(len(texts))
            if letters.any():
                best, p = scored([t for t, ok in zip(texts, letters) if ok], model)
                names[letters] = np.array(model.languages, dtype=object)[best]
                scores[letters] = p
            kept = [n for n in batch.schema.names if n != "_text" or "_text" in carry]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(names, pa.string()), pa.array(scores)], [*kept, "_lang_pred", "_score"])

    inner = docs.select(F.col(id_col).alias("_id"), held_out(id_col).alias("_held_out"), F.col(text_col).alias("_text"), *(F.col(c).alias(f"_c_{c}") for c in carry))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema if f.name != "_text"]
    out = inner.mapInArrow(run, ", ".join([*fields, "_lang_pred string", "_score double"]))
    return out.select(F.col("_id").alias(id_col), F.col("_held_out").alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score"), *(F.col(f"_c_{c}").alias(c) for c in carry if c != id_col))
