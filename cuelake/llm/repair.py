"""Re-Pair grammars over token ids: frequent neighbours become nonterminals, and any range of ids can be read back alone.

A shard is a byte string, all numbers little-endian:

    magic "RPG1"; u32 documents, terminals, rules; u64 symbols, ids; u8 bytes of a symbol (2 or 4); 3 bytes of nought
    u32 x terminals: the token id that symbol 0, 1, ... stands for
    u32 x rules: length of what symbol terminals + r expands to
    symbols x 2 x rules: the two symbols that a rule stands for; both are smaller than the rule's own
    u64 x (documents + 1): the symbol where each document begins
    symbols
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

MAGIC, HEADER = b"RPG1", struct.Struct("<4sIIIQQB3x")
#: A rule costs two symbols and a length, so a pair that occurs less often than this is left alone.
LEAST = 4
#: In each round the pairs that occur at least 1 / SHARE as often as the most frequent one are replaced.
SHARE = 16
#: Bits of the table that finds a pair's rule.
TABLE_BITS = 16


def _keys(s: np.ndarray, last: np.ndarray, count: int) -> tuple[np.ndarray, int]:
    """A number for each symbol and its right neighbour, all ones where a document ends, and the bits of its right half."""
    kind, bits = (np.uint32, 16) if count < 1 << 16 else (np.uint64, 32)
    s = s.astype(kind)
    keys = s[:-1] << kind(bits) | s[1:]
    keys[last[:-1]] = np.iinfo(kind).max
    return keys, bits


def _frequent(keys: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys, but for the one of all ones, that occur `least` times or more, and how often each does."""
    ordered = np.sort(keys)
    ordered = ordered[: np.searchsorted(ordered, np.iinfo(keys.dtype).max)]
    # The places whose key stands least - 1 places on as well: of a key that occurs n times, n - least + 1 side by side.
    at = np.flatnonzero(ordered[least - 1 :] == ordered[: max(len(ordered) - least + 1, 0)])
    kinds = ordered[at]
    starts = np.flatnonzero(np.concatenate([[True], kinds[1:] != kinds[:-1]])) if len(at) else at
    return kinds[starts], np.diff(starts, append=len(at)) + least - 1


def _places(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a key is one of wanted (the best first), and which. Of wanted keys that share a place in the table the best is found; the rest wait for the next round."""
    kind, odd, bits = (np.uint32, 0x9E3779B1, 32) if keys.dtype == np.uint32 else (np.uint64, 0x9E3779B97F4A7C15, 64)
    slot = lambda k: (k * kind(odd)) >> kind(bits - TABLE_BITS)
    # Nothing that is wanted has a key of all ones, so it can mark the empty places.
    table, holds = np.zeros(1 << TABLE_BITS, np.int32), np.full(1 << TABLE_BITS, np.iinfo(kind).max, kind)
    own = slot(wanted)[::-1]
    table[own], holds[own] = np.arange(len(wanted), dtype=np.int32)[::-1], wanted[::-1]
    at = slot(keys)
    found = np.flatnonzero((holds[at] == keys) & (keys != np.iinfo(kind).max))
    return found, table[at[found]]


def _apart(places: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Which of the places, ascending, are replaced: of two that overlap the one of the better rank, of equal ones the first, the third and so on."""
    touches = places[1:] == places[:-1] + 1
    chosen = ~(np.concatenate([[False], touches]) | np.concatenate([touches, [False]]))[: len(places)]
    open_ = np.flatnonzero(~chosen)
    p, r = places[open_], ranks[open_]
    while len(p):
        touches = p[1:] - p[:-1] == 1
        left = r[:-1] <= r[1:]
        best, near = np.ones(len(p), bool), np.zeros(len(p), bool)
        best[1:] = ~(touches & left)
        best[:-1] &= ~touches | left
        chosen[open_[best]] = True
        near[1:] = touches & best[:-1]
        near[:-1] |= touches & best[1:]
        rest = ~(best | near)
        open_, p, r = open_[rest], p[rest], r[rest]
    return chosen


def replaced(symbols: np.ndarray, starts: np.ndarray, terminals: int, least: int = LEAST, share: int = SHARE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What is left of symbols (all below terminals), which of them end a document, and the rules as pairs of symbols.

    starts: the n + 1 places where documents begin and end; none is empty.

    Round by round, the most frequent pairs inside documents give way to new symbols, the more frequent first where two overlap,
    until no pair can be replaced `least` times.
    """
    s, last = symbols.astype(np.uint32), np.zeros(len(symbols), bool)
    last[starts[1:] - 1] = True
    rules: list[np.ndarray] = []
    count, done = terminals, np.zeros(0, np.uint64)
    while len(s) > 1:
        keys, bits = _keys(s, last, count)
        kinds, n = _frequent(keys, least)
        sides = np.stack([kinds >> kinds.dtype.type(bits), kinds & kinds.dtype.type((1 << bits) - 1)], axis=1).astype(np.uint64)
        if len(done):
            live = ~np.isin(sides[:, 0] << np.uint64(32) | sides[:, 1], done)
            kinds, n, sides = kinds[live], n[live], sides[live]
        if not len(kinds):
            break
        top = np.flatnonzero(n >= max(least, n.max() // share))
        top = top[np.argsort(-n[top], kind="stable")]
        kinds, sides = kinds[top], sides[top]
        places, which = _places(keys, kinds)
        chosen = _apart(places, which)
        worth = np.bincount(which[chosen], minlength=len(kinds)) >= least
        # A pair that loses too many places to better ones is no rule now; in a round without any rule such pairs are done with.
        if not worth.any():
            tried = sides[np.unique(which)]
            done = np.union1d(done, tried[:, 0] << np.uint64(32) | tried[:, 1])
            continue
        chosen &= worth[which]
        number = count + np.cumsum(worth) - 1
        rules.append(sides[worth].astype(np.int64))
        count += int(worth.sum())
        at = places[chosen]
        s[at] = number[which[chosen]]
        last[at] = last[at + 1]
        keep = np.ones(len(s), bool)
        keep[at + 1] = False
        s, last = s[keep], last[keep]
    return s, last, np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)


def _filled(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts, starts + 1, ... of each run, one run after another."""
    ends = np.cumsum(sizes)
    out = np.repeat((starts - (ends - sizes)).astype(np.int32), sizes)
    out += np.arange(len(out), dtype=np.int32)
    return out


def shard(ids: np.ndarray, starts: np.ndarray, least: int = LEAST, share: int = SHARE) -> bytes:
    """The byte string of documents whose ids lie in ids (u32) from one of the n + 1 starts to the next."""
    full = np.flatnonzero(np.diff(starts) > 0)
    seen = np.zeros(int(ids.max(initial=0)) + 1, bool)
    seen[ids] = True
    terminals = np.flatnonzero(seen)
    symbols = (np.cumsum(seen, dtype=np.uint32) - 1)[ids]
    left, last, rules = replaced(symbols, np.append(starts[full], starts[-1]), len(terminals), least, share)
    begins = np.zeros(len(starts), np.int64)
    begins[full + 1] = np.flatnonzero(last) + 1
    begins = np.maximum.accumulate(begins)
    lengths = np.ones(len(terminals) + len(rules), np.int64)
    for r, (a, b) in enumerate(rules.tolist(), len(terminals)):
        lengths[r] = lengths[a] + lengths[b]
    width = 2 if len(lengths) <= 1 << 16 else 4
    packed = lambda x, size: x.astype(f"<u{size}").tobytes()
    head = HEADER.pack(MAGIC, len(starts) - 1, len(terminals), len(rules), len(left), len(ids), width)
    return b"".join([head, packed(terminals, 4), packed(lengths[len(terminals) :], 4), packed(rules.ravel(), width), packed(begins, 8), packed(left, width)])


@dataclass
class Shard:
    """A shard read back. `flat` holds the expansion of each symbol, from `place` on and as long as `length` says."""

    begins: np.ndarray
    symbols: np.ndarray
    length: np.ndarray
    place: np.ndarray
    flat: np.ndarray

    @classmethod
    def read(cls, data: bytes) -> Shard:
        magic, documents, terminals, rules, symbols, _, width = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        at = HEADER.size

        def take(n: int, size: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, f"<u{size}", n, at)
            at += n * size
            return out

        own = take(terminals, 4)
        length = np.concatenate([np.ones(terminals, np.int64), take(rules, 4).astype(np.int64)])
        pairs = take(2 * rules, width).astype(np.int64).reshape(-1, 2)
        begins, left = take(documents + 1, 8).astype(np.int64), take(symbols, width)
        place = np.cumsum(length) - length
        flat = np.zeros(int(length.sum()), np.uint32)
        flat[:terminals] = own
        # A rule is filled in once both of its sides are: as many steps as the grammar is deep.
        ready, open_ = np.arange(terminals + rules) < terminals, np.arange(rules)
        while len(open_):
            now = ready[pairs[open_]].all(axis=1)
            fill, open_ = open_[now], open_[~now]
            for side, shift in ((0, 0), (1, length[pairs[fill, 0]])):
                part = pairs[fill, side]
                flat[_filled(place[fill + terminals] + shift, length[part])] = flat[_filled(place[part], length[part])]
            ready[fill + terminals] = True
        return cls(begins, left, length, place, flat)

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the n + 1 places where each document's begin and end."""
        sizes = self.length[self.symbols]
        return self.flat[_filled(self.place[self.symbols], sizes)], np.concatenate([[0], np.cumsum(sizes)])[self.begins]

    def part(self, document: int, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of one document; only the symbols that reach into this range are expanded."""
        own = self.symbols[self.begins[document] : self.begins[document + 1]]
        ends = np.cumsum(self.length[own])
        total = int(ends[-1]) if len(ends) else 0
        start, stop = max(start, 0), min(stop, total)
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, final = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left")
        own = own[first : final + 1]
        skipped = start - int(ends[first] - self.length[own[0]])
        return self.flat[_filled(self.place[own], self.length[own])][skipped : skipped + stop - start]
