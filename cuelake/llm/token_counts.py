"""Token counts by a linear longest-match automaton over a word-piece vocabulary."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import slices
from cuelake.llm.tokens import WordCache, tokenizer_path, words_of

#: What marks a piece that begins a word in the vocabulary file.
WORD_START = "▁"


class LongestMatch:
    """A trie over a vocabulary with failure links; where a link is taken, the number of tokens it pops is known.

    Node 0 is where a word begins, node 1 where a token inside a word begins. From a node without the next character, the
    failure link leads to the longest suffix that may still become a token, after the tokens before it have been popped:
    one step of work for each character of a word, and only the number of tokens is ever kept.
    """

    def __init__(self, starts: list[str], inside: list[str]):
        self.next: list[dict[str, int]] = [{}, {}]
        token = [False, False]
        for root, pieces in ((0, starts), (1, inside)):
            for piece in pieces:
                at = root
                for c in piece:
                    if c not in self.next[at]:
                        self.next[at][c] = len(self.next)
                        self.next.append({})
                        token.append(False)
                    at = self.next[at][c]
                token[at] = at > 1
        self.fail: list[int] = [-1] * len(self.next)
        self.pops = [0] * len(self.next)
        todo = deque([0, 1])
        while todo:
            u = todo.popleft()
            for c, v in self.next[u].items():
                todo.append(v)
                if token[v]:
                    self.fail[v], self.pops[v] = 1, 1
                    continue
                z, popped = self.fail[u], self.pops[u]
                while z >= 0 and c not in self.next[z]:
                    popped += self.pops[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.pops[v] = self.next[z][c], popped

    def count(self, word: str) -> int:
        """Tokens of the greedy longest matches that make up word; 0 where some part of it matches none."""
        at, n = 0, 0
        for c in word:
            while c not in self.next[at]:
                if self.fail[at] < 0:
                    return 0
                n += self.pops[at]
                at = self.fail[at]
            at = self.next[at][c]
        while at > 1:
            if self.fail[at] < 0:
                return 0
            n += self.pops[at]
            at = self.fail[at]
        return n


def vocabulary(path: str) -> tuple[list[str], list[str]]:
    """Pieces that begin a word, without their mark, and pieces inside a word, of a sentencepiece model; control and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    marked = [p for p in pieces if WORD_START in p]
    return [p[1:] for p in marked if p[0] == WORD_START and len(p) > 1 and WORD_START not in p[1:]], [p for p in pieces if WORD_START not in p]


@cache
def automaton(path: str) -> LongestMatch:
    return LongestMatch(*vocabulary(path))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """id, n_words, n_tokens, n_unknown, longest_word_tokens: one row per input row.

    Words end at ASCII white space. A word with a part that no piece matches counts as one unknown token. Null and empty texts
    have no words and no tokens; rows that repeat give repeated rows; extra columns are ignored. Row-wise, without a shuffle;
    what a worker keeps of words is bounded by bytes (tokens.MOST_BYTES). model: path of a sentencepiece model on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = automaton(model or tokenizer_path("piece_bpe_32k.model"))
        known, of_word = WordCache(), np.zeros(1 << 14, np.int64)

        def learn(words: list[str]) -> None:
            nonlocal of_word
            first = len(known.of)
            while first + len(words) > len(of_word):
                of_word = np.concatenate([of_word, np.zeros_like(of_word)])
            of_word[first : first + len(words)] = [matcher.count(w) for w in words]
            known.add(words, 0)

        for batch in slices(batches, "text"):
            if known.held > known.most_bytes:
                known.clear()
            words, at, bounds = words_of(batch.column("text"))
            full = np.fromiter(map(len, words), np.int64, len(words))[at] > 0
            sizes = np.diff(np.concatenate([[0], np.cumsum(full)])[bounds])
            places = known.places(words, learn)
            counts = of_word[places][at][full]
            # A zero at the end lets reduceat begin behind the last word; rows without words are set to 0 after it.
            at, full = np.cumsum(sizes) - sizes, sizes > 0
            per_row = lambda values, f: np.where(full, f.reduceat(np.append(values, 0), at), 0)
            unknown = per_row((counts == 0).astype(np.int64), np.add)
            columns = [sizes, per_row(counts, np.add) + unknown, unknown, per_row(np.maximum(counts, 1), np.maximum)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c.astype(np.int64)) for c in columns)], ["id", "n_words", "n_tokens", "n_unknown", "longest_word_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_words long, n_tokens long, n_unknown long, longest_word_tokens long")
    return out.withColumnRenamed("id", id_col)
