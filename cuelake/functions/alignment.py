"""Alignment of two texts, as pandas UDFs: what Spark has no function for. Each works on one pair of strings of cue length."""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from difflib import SequenceMatcher
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits: one machine step for each character of b."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    rows, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        hit = rows & masks.get(c, 0)
        rows = ((rows + hit) | (rows - hit)) & full
    return len(a) - rows.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """100 * 2 * common / total length; 0 where either is empty."""
    return 200.0 * common_length(a, b) / (len(a) + len(b)) if a and b else 0.0


def edit_distance(a: str, b: str) -> int:
    """Inserted, deleted and replaced characters. Equal heads and tails cost nothing; the rest is a column of the usual table at a time, as two whole numbers with the bits of its rises and falls."""
    if a == b:
        return 0
    head = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    a, b = a[head:], b[head:]
    tail = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b))) if x != y), min(len(a), len(b)))
    long, short = sorted((a[: len(a) - tail], b[: len(b) - tail]), key=len, reverse=True)
    if not short:
        return len(long)
    n = len(long)
    masks: dict[str, int] = {}
    for i, c in enumerate(long):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, out = full, 0, n
    for c in short:
        same = masks.get(c, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        rises, falls = down | (full & ~(diagonal | up)), up & diagonal
        out += bool(rises & top) - bool(falls & top)
        rises, falls = (rises << 1 | 1) & full, (falls << 1) & full
        up, down = falls | (full & ~((same | down) | rises)), rises & (same | down)
    return out


def best_window(a: str, b: str) -> float:
    """The best indel ratio of the shorter text with a window of the longer one, as long as it or standing over an edge.

    One step of a window changes what it has in common with the text by one character at most. So behind a window that falls
    short of the best one so far, as many are passed over as that takes to make up.
    """
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 0.0
    if short in long:
        return 100.0
    n = len(short)
    most, i = 0, 0  # characters in common with the best whole window
    while i <= len(long) - n:
        common = common_length(short, long[i : i + n])
        i += max(1, most - common + 1)
        most = max(most, common)
    best = 100.0 * most / n
    for edge in (lambda w: long[:w], lambda w: long[-w:]):
        w = 1
        while w < n:
            if 200.0 * w / (n + w) > best:
                common = common_length(short, edge(w))
                best = max(best, 200.0 * common / (n + w))
            else:
                common = w
            # The next width that could beat the best: 200 (common + d) > best (n + w + d).
            w += max(1, math.floor((best * (n + w) - 200.0 * common) / (200.0 - best)))
    return best


def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel_ratio(x or "", y or "") for x, y in zip(a, b)])


def _window_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([best_window(x or "", y or "") for x, y in zip(a, b)])


def closest_text(heard: str, text: str, candidates: list[str]) -> str | None:
    """The candidate that matches what was heard best, if it does so better than text; of equals the last by name. Those whose characters, in whatever order, have too few in common aren't aligned."""
    share = lambda x: 2.0 * sum(size for _, _, size in matching_blocks(heard, x)) / (len(heard) + len(x)) if heard or x else 1.0
    best, found, held = share(text), None, Counter(heard)
    bounds = sorted(((2.0 * (held & Counter(c)).total() / max(1, len(heard) + len(c)), c) for c in candidates), reverse=True)
    for bound, candidate in bounds:
        if bound < best:
            break
        score = share(candidate)
        if score > best or (found is not None and score == best and candidate > found):
            best, found = score, candidate
    return found


def _closest(heard: pd.Series, text: pd.Series, candidates: pd.Series) -> pd.Series:
    return pd.Series([closest_text(h or "", t or "", list(c)) for h, t, c in zip(heard, text, candidates)], dtype=object)


def _edits(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else edit_distance(x, y) for x, y in zip(a, b)], dtype="Int32")


def _matched_share(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 * matching characters / all, as matching blocks give them."""
    return pd.Series([SequenceMatcher(None, x or "", y or "", autojunk=False).ratio() for x, y in zip(a, b)])


def holds_something_alike(short: str, long: str, percent: int) -> bool:
    """Whether a stretch of long that is as long as short matches it by `percent`.

    A stretch is compared only if it has that many characters in common, first in whatever order (this count follows the stretch
    along), then in order. The latter changes by one a step at most, so behind a stretch that falls short as many are passed over.
    """
    n, needed = len(short), -(-percent * len(short) // 100)
    left = Counter(short)  # what of short the stretch doesn't have yet; below zero what it has too often
    common = behind = 0
    for i, c in enumerate(long):
        common += left[c] > 0
        left[c] -= 1
        if i >= n:
            gone = long[i - n]
            left[gone] += 1
            common -= left[gone] > 0
        if i >= n - 1 and i >= behind and common >= needed:
            stretch = long[i - n + 1 : i + 1]
            in_order = common_length(short, stretch)
            if in_order < needed:
                behind = i + needed - in_order
            elif 100 * SequenceMatcher(None, short, stretch).ratio() >= percent:
                return True
    return False


#: Lengths of grams by which a longest block is looked for; the last one finds blocks of any length.
GRAMS = (6, 3, 1)


def matching_blocks(a: str, b: str) -> list[tuple[int, int, int]]:
    """(place in a, place in b, length) of the blocks that SequenceMatcher(None, a, b, autojunk=False) finds.

    A block of n characters is a run of n - k + 1 equal grams of length k. So a longest block is looked for by long grams, of
    which a text has few equal ones, and by shorter ones only where no block is as long; of equals the first in a, then in b.
    """
    places: dict[int, dict[str, list[int]]] = {}
    for k in GRAMS:
        found = places[k] = {}
        for j in range(len(b) - k + 1):
            found.setdefault(b[j : j + k], []).append(j)

    def longest(alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        for k in GRAMS:
            best, at = 0, (alo, blo)
            runs: dict[int, int] = {}
            for i in range(alo, ahi - k + 1):
                grown: dict[int, int] = {}
                js = places[k].get(a[i : i + k], ())
                for x in range(bisect_left(js, blo), len(js)):
                    j = js[x]
                    if j > bhi - k:
                        break
                    n = grown[j] = runs.get(j - 1, 0) + 1
                    if n > best:
                        best, at = n, (i - n + 1, j - n + 1)
                runs = grown
            if best:
                return (*at, best + k - 1)
        return alo, blo, 0

    todo, blocks = [(0, len(a), 0, len(b))], []
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        i, j, size = longest(alo, ahi, blo, bhi)
        if size:
            blocks.append((i, j, size))
            if alo < i and blo < j:
                todo.append((alo, i, blo, j))
            if i + size < ahi and j + size < bhi:
                todo.append((i + size, ahi, j + size, bhi))
    return sorted(blocks)


def matched_characters(words: list[str], shown: str) -> list[int]:
    """How many characters of each word lie in the matching blocks of all words and the text shown."""
    ends = list(accumulate(map(len, words)))
    hits = [0] * len(words)
    at = 0
    for a, _, size in matching_blocks("".join(words), shown):
        stop = a + size
        while a < stop:
            at = bisect_right(ends, a, at)
            step = min(stop, ends[at]) - a
            hits[at] += step
            a += step
    return hits


def _replaced_phrases(machine: pd.Series, final: pd.Series) -> pd.Series:
    """Phrases that a reviewer has replaced, as runs of tokens, with three tokens to either side in the reviewed text."""

    def of(m: str, f: str) -> list[dict]:
        a, b = m.split(), f.split()
        codes = SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
        return [{"wrong": " ".join(a[i:j]), "right": " ".join(b[k:n]), "context": " ".join(b[max(0, k - 3) : n + 3])} for op, i, j, k, n in codes if op == "replace"]

    return pd.Series([of(m or "", f or "") for m, f in zip(machine, final)])


def _replaced_tokens(machine: pd.Series, final: pd.Series) -> pd.Series:
    """Tokens (given as texts with single blanks) that changed one for one."""

    def of(m: str, f: str) -> list[dict]:
        a, b = m.split(), f.split()
        codes = SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
        return [{"wrong": x, "right": y} for op, i, j, k, n in codes if op == "replace" and j - i == n - k for x, y in zip(a[i:j], b[k:n])]

    return pd.Series([of(m or "", f or "") for m, f in zip(machine, final)])


#: Rows of the table of common lengths that are kept between two that are kept for good.
ROWS = 256


def token_diff(s: list[str], t: list[str]) -> tuple[list[str], list[str]]:
    """Tokens that only s or only t has, by a longest common subsequence; where there is a choice, equal tokens at the same time are kept, and a token of s goes before one of t.

    Row i of the table of common lengths of s[i:] and t[j:] is one number: bit j tells whether it falls by one from j to j + 1.
    A row follows from the next one by a few operations on whole numbers. Every ROWS-th row is kept; those between are made
    again when the way through the table comes by, so memory is that of the square root of a table of bits.
    """
    n, m = len(s), len(t)
    masks: dict[str, int] = {}
    for j, token in enumerate(reversed(t)):  # reversed, so that carries run towards smaller j
        masks[token] = masks.get(token, 0) | 1 << j
    full = (1 << m) - 1

    def above(row: int, token: str) -> int:
        hit = row & masks.get(token, 0)
        return ((row + hit) | (row - hit)) & full

    # In these rows a bit is clear where the length falls; bit m - 1 - j belongs to j.
    kept, row = {n: full}, full
    for i in range(n - 1, -1, -1):
        row = above(row, s[i])
        if i % ROWS == 0:
            kept[i] = row
    rows: dict[int, int] = {}

    def at(i: int) -> int:
        if i not in rows:
            rows.clear()
            last = min(n, (i // ROWS + 1) * ROWS)
            rows[last] = kept[last]
            for k in range(last - 1, i - 1, -1):
                rows[k] = above(rows[k + 1], s[k])
        return rows[i]

    length = lambda i, j: (m - j) - (at(i) & ((1 << (m - j)) - 1)).bit_count()
    i = j = 0
    gone, new = [], []
    while i < n and j < m:
        if s[i] == t[j]:
            i, j = i + 1, j + 1
            continue
        right = length(i, j + 1)
        if length(i + 1, j) >= right:
            gone.append(s[i])
            i += 1
        else:
            new.append(t[j])
            j += 1
    return gone + s[i:], new + t[j:]


def _token_changes(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Tokens, white space included, that only one of the texts has."""
    split = lambda x: re.findall(r"\s+|\S+", x or "")
    return pd.DataFrame([token_diff(split(x), split(y)) for x, y in zip(a, b)], columns=["deleted", "inserted"])


def similarity(a: Column | str, b: Column | str) -> Column:
    return F.pandas_udf(_similarity, "double")(a, b)


def window_similarity(a: Column | str, b: Column | str) -> Column:
    return F.pandas_udf(_window_similarity, "double")(a, b)


def edits(a: Column | str, b: Column | str) -> Column:
    """Null where a text is null."""
    return F.pandas_udf(_edits, "int")(a, b)


def closest(heard: Column | str, text: Column | str, candidates: Column | str) -> Column:
    """Worked out once a row: a filter on it is not pushed below, where it would be worked out for itself."""
    return F.pandas_udf(_closest, "string").asNondeterministic()(heard, text, candidates)


def holds_alike(short: Column, long: Column, percent: int) -> Column:
    """False where one of them is null."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([x is not None and y is not None and holds_something_alike(x, y, percent) for x, y in zip(a, b)], dtype=bool)

    return F.pandas_udf(run, "boolean")(short, long)


def matched_by_word(words: Column, shown: Column) -> Column:
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([matched_characters(list(x), y or "") if x is not None else None for x, y in zip(a, b)])

    return F.pandas_udf(run, "array<int>")(words, shown)


def replaced_phrases(machine: Column | str, final: Column | str) -> Column:
    return F.pandas_udf(_replaced_phrases, "array<struct<wrong:string,right:string,context:string>>")(machine, final)


def replaced_tokens(machine: Column | str, final: Column | str) -> Column:
    return F.pandas_udf(_replaced_tokens, "array<struct<wrong:string,right:string>>")(machine, final)


def token_changes(a: Column | str, b: Column | str) -> Column:
    return F.pandas_udf(_token_changes, "struct<deleted:array<string>,inserted:array<string>>")(a, b)
