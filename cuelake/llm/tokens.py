"""Tokens of public tokenizers for whole columns of texts, through a bounded cache of words."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that the words a Python worker keeps may take, by estimate; then it starts anew. Only speed depends on it.
MOST_BYTES = 64 << 20
#: What a word takes besides its own bytes and ids: its entry in a dictionary, its string object and its places.
ENTRY_BYTES = 150
#: Words encoded in one call.
TOGETHER = 512


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def distinct_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of the texts (null: none), the word at each place, and the n + 1 places where each text's begin and end.

    Words end at ASCII white space. At the edges of a text the empty word may stand.
    """
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    offsets = np.asarray(split.offsets).astype(np.int64)
    found = split.flatten().dictionary_encode()
    return found.dictionary, found.indices.to_numpy(), offsets - offsets[0]


def words_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """distinct_words() with the words as a list."""
    words, at, bounds = distinct_words(texts)
    return words.to_pylist(), at, bounds


class WordCache:
    """Places of words met before; `learn` is told the new ones, in order. Cleared between batches once it is too large, so a batch's own words are the only excess."""

    def __init__(self, most_bytes: int = MOST_BYTES):
        self.most_bytes = most_bytes
        self.clear()

    def clear(self) -> None:
        self.of: dict[str, int] = {}
        self.held = 0

    def places(self, words: list[str], learn: Callable[[list[str]], None]) -> np.ndarray:
        if new := [w for w in words if w not in self.of]:
            learn(new)
        return np.fromiter(map(self.of.__getitem__, words), np.int64, len(words))

    def add(self, words: list[str], more_bytes: int) -> None:
        first = len(self.of)
        self.of.update(zip(words, range(first, first + len(words))))
        self.held += sum(map(len, words)) + ENTRY_BYTES * len(words) + more_bytes


@cache
def word_ids(path: str | None) -> WordIds:
    return WordIds(path or tokenizer_path("word_bpe_49k.json"))


class WordIds:
    """Ids of texts under a tokenizer that drops white space, so a text's ids are those of its words one after another.

    No token of such a tokenizer crosses white space. Each word is encoded by the tokenizer once; its ids stay in one buffer,
    from which a batch of texts is gathered by numpy. As the tokenizer lowers letters, A-Z are lowered first (but in a text
    that might name a special token), and as it parts letters from signs, a word that ends in signs is that without them and
    the signs' own ids. Words of plain lower letters, which normalising and splitting leave whole, go to the tokenizer's model
    many at a time: a token with the mark of a word's end closes each.
    """

    PLAIN = re.compile("[a-zß-öø-ÿ]+")
    SIGNED = re.compile(r"([a-zß-öø-ÿ]+)([!-/:-@\[-`{-~]+)")
    SIGNS = (".", ",", "!!", "$$$", ".&&", "'", ").")
    PROBES = ("a", "the", "straße", "été", "queueing", "zzxq", "niño")

    def __init__(self, path: str, most_bytes: int = MOST_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        one = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        self.lowers = one("ABCXYZ") == one("abcxyz")
        self.parts = all(one(f"été{sign}") == one("été") + one(sign) for sign in self.SIGNS)
        self.model = None
        if suffix := json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix"):
            model = Tokenizer.from_file(path)
            model.normalizer = None
            model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.closes[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
            if all(model.encode(w, add_special_tokens=False).ids == one(w) for w in self.PROBES):
                self.model = model
        self.known = WordCache(most_bytes)
        self.last: tuple[pa.Array, np.ndarray] | None = None  # the words of the batch before, and their places
        self.ids, self.starts, self.sizes, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *(np.array(x, np.uint32) for x in lists)]), np.fromiter(map(len, lists), np.int64, len(lists))

    def encoded_plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lines = [" ".join(words[i : i + TOGETHER]) for i in range(0, len(words), TOGETHER)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.model.encode_batch_fast(lines, add_special_tokens=False)])
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(words):  # a model without a closing token for some letter
            return self.encoded(words)
        return ids, np.diff(ends, prepend=0)

    def add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        first = len(self.known.of)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while first + len(words) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[first : first + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[first : first + len(words)] = sizes
        self.used += len(ids)
        self.known.add(words, 4 * len(ids))

    def gathered(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after another, and where each word's end."""
        sizes = self.sizes[words]
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.starts[words] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)], ends

    def learn(self, words: list[str]) -> None:
        signed = [m for m in map(self.SIGNED.fullmatch, words) if m] if self.parts else []
        rest = set(words).difference(m[0] for m in signed).union(*(m.groups() for m in signed)).difference(self.known.of)
        plain = [w for w in rest if self.PLAIN.fullmatch(w)] if self.model else []
        if plain:
            self.add(plain, *self.encoded_plain(plain))
        if other := sorted(rest.difference(plain)):
            self.add(other, *self.encoded(other))
        if signed:
            both = np.fromiter((self.known.of[part] for m in signed for part in m.groups()), np.int64, 2 * len(signed))
            ids, ends = self.gathered(both)
            self.add([m[0] for m in signed], ids, np.diff(ends[1::2], prepend=0))

    def places(self, words: pa.Array) -> np.ndarray:
        """Places of the distinct words of a batch. Most stood in the batch before, so these are looked up in Arrow, all at once."""
        if self.last is None:
            out = self.known.places(words.to_pylist(), self.learn)
        else:
            found = pc.index_in(words, self.last[0])
            hit = found.is_valid()
            mask, out = hit.to_numpy(zero_copy_only=False), np.empty(len(words), np.int64)
            out[mask] = self.last[1][found.drop_null().to_numpy()]
            out[~mask] = self.known.places(words.filter(pc.invert(hit)).to_pylist(), self.learn)
        self.last = words, out
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null: none), and the n + 1 places where each text's begin and end."""
        if self.known.held > self.known.most_bytes:
            self.known.clear()
            self.used, self.last = 0, None
        if self.lowers:
            texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        words, at, bounds = distinct_words(texts)
        ids, ends = self.gathered(self.places(words)[at])
        return ids, np.concatenate([[0], ends])[bounds]
