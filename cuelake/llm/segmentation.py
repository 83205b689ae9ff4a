"""Sampled segmentations of texts into sentencepiece pieces, without replacement, and their decoding."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import slices
from cuelake.llm.shingles import mixed
from cuelake.llm.tokens import WordCache, tokenizer_path

SPACE = "▁"
#: Bytes of text that are searched together, ids that are decoded together, and bytes of lattices that a Python worker keeps.
AT_ONCE, DECODED_AT_ONCE, KEPT_BYTES = 1 << 19, 1 << 17, 48 << 20
#: The scores of a BPE model are ranks; a piece's log weight is its score times this.
ALPHA = 5e-4
#: Scores below this mark pieces that only stand in the vocabulary (runs of spaces).
UNUSED = -1e8
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def uniform(seed: np.ndarray, *parts: np.ndarray | int) -> np.ndarray:
    """Numbers in (0, 1) that depend on the row's seed and the parts alone."""
    x = seed
    for part in parts:
        x = mixed(x + np.asarray(part).astype(np.uint64) * GOLDEN + np.uint64(1))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def carried(h: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Hashes of texts that are one character longer."""
    return (h + points + np.uint64(1)) * GOLDEN


class Spellings:
    """The bytes that each id of a model file stands for: all that decoding needs."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.model, self.size = model, model.vocab_size()
        self.bytes_of, self.byte_ids = [b""] * self.size, [0] * 256
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
                self.byte_ids[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i)):
                self.bytes_of[i] = piece.replace(SPACE, " ").encode()
        self.sizes = np.fromiter(map(len, self.bytes_of), np.int64, self.size)
        self.line, self.places = np.frombuffer(b"".join(self.bytes_of), np.uint8), np.cumsum(self.sizes) - self.sizes

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the texts whose ids lie between bounds, one after another, and their own bounds; the space that encoding has put first is taken off."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        data = self.line[np.repeat(self.places[ids] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
        at = np.concatenate([[0], ends])[bounds]
        marked = np.flatnonzero(np.diff(at))
        marked = marked[data[at[:-1][marked]] == 32]
        return np.delete(data, at[:-1][marked]), at - np.searchsorted(marked, np.arange(len(at)))


class Pieces(Spellings):
    """The vocabulary of a model file: log weights and ids by piece, and by the hash of its characters."""

    def __init__(self, path: str, alpha: float):
        super().__init__(path)
        model, self.known, least, self.longest = self.model, {}, 0.0, 1  # known: None stands for what only begins a piece
        for i in range(self.size):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) and (score := model.get_score(i)) > UNUSED:
                piece = model.id_to_piece(i)
                self.known[piece] = (alpha * score, i)
                least, self.longest = min(least, alpha * score), max(self.longest, len(piece))
        # The mark of a space alone has no score to speak of, but stands where no piece begins with it.
        self.known[SPACE] = (least - 1.0, model.piece_to_id(SPACE))
        for piece in list(self.known):
            for end in range(1, len(piece)):
                self.known.setdefault(piece[:end], None)
        self.fallback = least - 1.0
        # Every beginning of a piece is known too, so its hash can be carried on by one character.
        hash_of, hashes = {"": 1}, {}
        for size in range(1, self.longest + 1):
            at = [p for p in self.known if len(p) == size]
            h = carried(np.array([hash_of[p[:-1]] for p in at], np.uint64), np.array([ord(p[-1]) for p in at], np.uint64))
            hash_of.update(zip(at, h.tolist()))
            hashes.update((x, self.known[p] or (0.0, -1)) for x, p in zip(h.tolist(), at))
        self.hashes = np.array(sorted(hashes), np.uint64)
        self.id_of = np.array([hashes[int(h)][1] for h in self.hashes], np.int64)
        self.weight_of = np.array([hashes[int(h)][0] for h in self.hashes])
        # Where the hashes of each leading 20 bits begin: a few steps from there find a hash.
        buckets = np.searchsorted(self.hashes >> np.uint64(44), np.arange((1 << 20) + 1, dtype=np.uint64))
        self.bucket, self.steps = buckets[:-1].astype(np.int32), int(np.diff(buckets).max())

    def place(self, h: np.ndarray) -> np.ndarray:
        """Where each hash stands among the known ones, or where another one stands if it is not known."""
        last = len(self.hashes) - 1
        at = np.minimum(self.bucket[(h >> np.uint64(44)).astype(np.int64)], last)
        for _ in range(self.steps - 1):
            at = np.minimum(at + (self.hashes[at] < h), last)
        return at


@cache
def pieces(path: str | None, alpha: float) -> Pieces:
    return Pieces(path or tokenizer_path("piece_bpe_32k.model"), alpha)


@cache
def spellings(path: str | None) -> Spellings:
    return Spellings(path or tokenizer_path("piece_bpe_32k.model"))


@cache
def lattices_of(path: str | None, alpha: float) -> Lattices:
    return Lattices(pieces(path, alpha))


def units_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct units of the texts without the space before them, the unit at each place, and each text's number of units.

    A unit begins at each space, which no piece crosses; an empty text has none.
    """
    split = pc.split_pattern(texts, " ")
    offsets = np.asarray(split.offsets).astype(np.int64)
    found = split.flatten().dictionary_encode()
    full = pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0
    counts = np.diff(offsets)
    at = found.indices.to_numpy()[np.repeat(full, counts)]
    return found.dictionary, at, np.where(full, counts, 0)


class Lattices:
    """Lattices of the units met so far in one line of edges by node, each edge with its node's share of paths up to it.

    Weights are turned into conditional probabilities from the end of a unit to its start, so a path sampled forwards has its
    exact probability among all segmentations, and a unit's last node is where the next unit begins. All new units of a batch
    are built at once: pieces are found by the hash of their characters, one length after another, and node weights by the
    distance to the unit's end. A unit's numbers are the same whatever it is built with. What is kept is bounded by bytes: the
    line begins anew before the batch that finds it too long.
    """

    def __init__(self, vocabulary: Pieces, most_bytes: int = KEPT_BYTES):
        self.vocabulary, self.known = vocabulary, WordCache(most_bytes)
        self.last: tuple[pa.Array, np.ndarray] | None = None  # the units of the batch before, and their places
        self.nodes = self.edges = 0
        self.start, self.first = np.zeros(1 << 10, np.int64), np.zeros(1 << 14, np.int64)
        self.node, self.to, self.piece = (np.zeros(1 << 15, np.int32) for _ in range(3))
        self.lp, self.share = np.zeros(1 << 15), np.zeros(1 << 15)

    def starts(self, units: pa.Array) -> np.ndarray:
        """The first node of each of the distinct units of a batch. Many stood in the batch before, so these are looked up in Arrow, all at once."""
        if self.known.held > self.known.most_bytes:
            self.known.clear()
            self.nodes = self.edges = 0
            self.last = None
        spelt = lambda some: [f"{SPACE}{w}" for w in some.to_pylist()]
        if self.last is None:
            at = self.known.places(spelt(units), self.learn)
        else:
            found = pc.index_in(units, self.last[0])
            hit = found.is_valid()
            mask, at = hit.to_numpy(zero_copy_only=False), np.empty(len(units), np.int64)
            at[mask] = self.last[1][found.drop_null().to_numpy()]
            at[~mask] = self.known.places(spelt(units.filter(pc.invert(hit))), self.learn)
        self.last = units, at
        return self.start[at]

    def put(self, name: str, at: int, values: np.ndarray) -> None:
        line = getattr(self, name)
        while at + len(values) > len(line):
            line = np.concatenate([line, np.zeros_like(line)])
        line[at : at + len(values)] = values
        setattr(self, name, line)

    def learn(self, units: list[str]) -> None:
        vocabulary = self.vocabulary
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n, ends = len(points), np.cumsum(sizes)
        left = np.repeat(ends, sizes) - np.arange(n)
        many = np.zeros(n, np.int32)
        found: list[tuple] = []  # node, its number of shorter edges, size, piece, weight
        at, h = np.arange(n), np.ones(n, np.uint64)
        for size in range(1, vocabulary.longest + 1):
            if size > 1:
                inside = left[at] >= size
                at, h = at[inside], h[inside]
            h = carried(h, points[at + (size - 1)])
            place = vocabulary.place(h)
            known = vocabulary.hashes[place] == h
            at, h, place = at[known], h[known], place[known]
            ids = vocabulary.id_of[place]
            real = ids >= 0
            node = at[real]
            found.append((node, many[node], size, ids[real], vocabulary.weight_of[place[real]]))
            many[node] += 1
            if size == 1:  # a character without a piece stands for its bytes
                alone = np.flatnonzero(many == 0)
                found.append((alone, many[alone], 1, vocabulary.size + points[alone].astype(np.int64), np.full(len(alone), vocabulary.fallback)))
                many[alone] += 1
        first = np.concatenate([[0], np.cumsum(many, dtype=np.int64)])
        count = int(first[-1])
        source = np.repeat(np.arange(n), many)
        to, piece, lp = np.empty(count, np.int64), np.empty(count, np.int64), np.empty(count)
        for node, rank, size, ids, weight in found:
            e = first[node] + rank
            to[e], piece[e], lp[e] = node + size, ids, weight
        # A unit's end is no node: it has a place of its own behind all nodes, with nothing left to weigh.
        to[to == np.repeat(ends, sizes)[source]] = n
        # From the units' ends backwards, all nodes at the same distance together.
        nodes = np.argsort(left.astype(np.uint16) if left.max() < 1 << 16 else left, kind="stable")
        degree = many[nodes].astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(degree)])
        edges = np.repeat(first[nodes] - upto[:-1], degree) + np.arange(count)
        weight, target, beta = lp[edges], to[edges], np.zeros(n + 1)
        level = np.searchsorted(left[nodes], np.arange(1, int(left.max()) + 2))
        for a, b in zip(level[:-1].tolist(), level[1:].tolist()):
            x, y = upto[a], upto[b]
            w, starts = weight[x:y] + beta[target[x:y]], upto[a:b] - x
            most = np.maximum.reduceat(w, starts)
            beta[nodes[a:b]] = most + np.log(np.add.reduceat(np.exp(w - np.repeat(most, degree[a:b])), starts))
        lp += beta[to] - beta[source]
        lp[many[source] == 1] = 0.0
        share = np.exp(lp)
        for k in range(1, int(many.max())):  # each node's sums apart, so that they don't depend on the batch
            later = first[:-1][many > k] + k
            share[later] += share[later - 1]
        share[first[1:] - 1] = 1.0
        self.put("start", len(self.known.of), ends - sizes + self.nodes)
        self.put("first", self.nodes, first + self.edges)
        for name, values in (("node", source + self.nodes), ("to", np.where(to == n, -1, to + self.nodes)), ("piece", piece), ("lp", lp), ("share", share)):
            self.put(name, self.edges, values)
        self.nodes, self.edges = self.nodes + n, self.edges + count
        self.known.add(units, 28 * count + 8 * n)

    def rest(self, edge: np.ndarray) -> np.ndarray:
        """What the other edges of each edge's node share: where one takes all but a millionth, their sum, as 1 - p has few digits left."""
        lp = self.lp[edge]
        out = -np.expm1(lp)
        close = np.flatnonzero(lp > -1e-6)
        node = self.node[edge[close]]
        many = self.first[node + 1] - self.first[node]
        close, node, many = close[many > 1], node[many > 1], many[many > 1]
        out[close] = 0.0
        for k in range(int(many.max()) if len(close) else 0):
            other = self.first[node] + k
            real = (k < many) & (other != edge[close])
            out[close[real]] += np.exp(self.lp[other[real]])
        return out

    def chosen(self, nodes: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The edge of each node that holds the share u."""
        edge = self.first[nodes]
        more = np.flatnonzero(self.share[edge] <= u)
        while len(more):
            edge[more] += 1
            more = more[self.share[edge[more]] <= u[more]]
        return edge


def walk(at: Lattices, nodes: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A random path from each node to its unit's end, all at once: the number of steps of each, and the edges, one path after another."""
    walkers, sizes, taken = np.arange(len(nodes)), np.zeros(len(nodes), np.int64), []
    while len(walkers):
        edge = at.chosen(nodes, uniform(seeds[walkers], len(taken)))
        taken.append((walkers, edge))
        sizes[walkers] += 1
        nodes = at.to[edge]
        on = nodes >= 0
        walkers, nodes = walkers[on], nodes[on]
    first = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), np.int64)
    for step, (walkers, edge) in enumerate(taken):
        out[first[walkers] + step] = edge
    return sizes, out


def within(sizes: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each n of sizes, one after another."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def below(bound: np.ndarray, mass: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The greatest of Gumbel numbers with a log mass, given that it lies below bound."""
    with np.errstate(divide="ignore"):
        return -np.logaddexp(-bound, np.log(-np.log(u)) - mass)


class Search:
    """Gumbel top-k over the segmentations of many texts at once: perturbed A-star, a set of segmentations at a time.

    All segmentations of a text are one set, whose greatest perturbed log-probability is a standard Gumbel number and belongs
    to a path drawn from it. What is left of a set without its best path falls apart by the step at which a path leaves it:
    same edges before, another edge there, anything after. Each part's greatest value is a Gumbel number at its log mass, cut
    off at the set's. The parts wait with these values, which are exact bounds; the greatest one is opened next. So the k paths
    with the greatest values come out in order, all different, and the next waiting value is the threshold of inclusion.
    """

    def __init__(self, at: Lattices, starts: np.ndarray, counts: np.ndarray, seeds: np.ndarray):
        self.at, self.starts, self.seeds = at, starts, seeds
        self.unit_bounds = np.concatenate([[0], np.cumsum(counts)])
        self.doc_of_unit = np.repeat(np.arange(len(counts)), counts)
        self.unit_no = np.arange(len(starts)) - self.unit_bounds[self.doc_of_unit]
        # Of each round: for every step its unit, place in the unit, edge, value of the part that leaves here, and log mass up to it.
        self.rounds: list[dict[str, np.ndarray]] = []
        self.excluded: dict[tuple[int, int], list[int]] = {}

    def opened(self, docs: np.ndarray, unit: np.ndarray, step: np.ndarray, edge: np.ndarray, bound: np.ndarray, branch: dict[int, int]) -> None:
        """Notes the paths of a round (steps in order, of the docs named) and draws the values of the parts beside them."""
        doc = self.doc_of_unit[unit]
        lp = self.at.lp[edge]
        first = np.searchsorted(doc, docs)
        upto = np.concatenate([np.cumsum(x) for x in np.split(lp, first[1:])]) - lp
        r = len(self.rounds)
        leaves = np.zeros(len(doc), bool)  # steps before the one where a path left its set belong to the set it left
        places = {d: int(first[np.searchsorted(docs, d)]) for d in branch}
        for d, at in branch.items():
            leaves[places[d] : places[d] + at] = True
        open_ = np.flatnonzero(~leaves)
        other = self.at.rest(edge[open_])
        for d, at in branch.items():
            node = self.at.node[edge[places[d] + at]]
            other[np.searchsorted(open_, places[d] + at)] = sum(np.exp(self.at.lp[e]) for e in range(self.at.first[node], self.at.first[node + 1]) if e not in self.excluded[r, d])
        with np.errstate(divide="ignore"):
            mass = upto[open_] + np.log(np.maximum(other, 0))
        limits = np.zeros(len(self.seeds))
        limits[docs] = bound
        own = doc[open_]
        drawn = below(limits[own], mass, uniform(self.seeds[own], 1000 + r, unit[open_] - self.unit_bounds[own], step[open_]))
        drawn[mass == -np.inf] = -np.inf
        value = np.full(len(doc), -np.inf)
        value[open_] = drawn
        total = np.add.reduceat(lp, first)
        self.rounds.append({"docs": docs, "first": np.append(first, len(doc)), "unit": unit, "step": step, "edge": edge, "value": value, "log_prob": total, "perturbed": bound})

    def begin(self) -> None:
        sizes, edge = walk(self.at, self.starts, mixed(self.seeds[self.doc_of_unit] + self.unit_no.astype(np.uint64) * GOLDEN))
        docs = np.unique(self.doc_of_unit)
        self.opened(docs, np.repeat(np.arange(len(sizes)), sizes), within(sizes), edge, -np.log(-np.log(uniform(self.seeds[docs], 999))), {})

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text the greatest waiting value, its round, and its place there (-inf: nothing waits)."""
        value, of_round, place = np.full(len(self.seeds), -np.inf), np.zeros(len(self.seeds), np.int64), np.zeros(len(self.seeds), np.int64)
        for r, x in enumerate(self.rounds):
            top = np.maximum.reduceat(x["value"], x["first"][:-1])
            hits = np.flatnonzero(x["value"] == np.repeat(top, np.diff(x["first"])))
            at = hits[np.searchsorted(hits, x["first"][:-1])]
            better = top > value[x["docs"]]
            docs = x["docs"][better]
            value[docs], of_round[docs], place[docs] = top[better], r, at[better]
        return value, of_round, place

    def next(self) -> None:
        value, of_round, place = self.best()
        docs = np.flatnonzero(value > -np.inf)
        r = len(self.rounds)
        u = uniform(self.seeds, 2000 + r)
        before, alternative, start, branch = [], [], [], {}
        for d in docs.tolist():
            x, i = self.rounds[of_round[d]], int(place[d])
            first = int(x["first"][np.searchsorted(x["docs"], d)])
            edge = int(x["edge"][i])
            gone = self.excluded.get((of_round[d], d)) if (of_round[d], d, i - first) in self.excluded_at else None
            gone = list(gone or [edge])
            node = self.at.node[edge]
            a, b = self.at.first[node], self.at.first[node + 1]
            options = [e for e in range(a, b) if e not in gone]
            shares = np.cumsum(np.exp(self.at.lp[options]))
            chosen = options[min(int(np.searchsorted(shares, u[d] * shares[-1], "right")), len(options) - 1)]
            x["value"][i] = -np.inf
            self.excluded[r, d] = [*gone, chosen]
            self.excluded_at.add((r, d, i - first))
            branch[d] = i - first
            before.append((x, first, i))
            alternative.append(chosen)
            start.append((int(x["unit"][i]), int(x["step"][i]), int(self.at.to[chosen])))
        if not len(docs):
            return
        # A path: its steps before the branch, the other edge, what is left of that edge's unit, and all units after it.
        unit, step, node = (np.array(c, np.int64) for c in zip(*start))
        units = self.unit_bounds[docs + 1] - unit - (node < 0)
        walkers = np.repeat(unit + (node < 0), units) + within(units)
        heads = (np.cumsum(units) - units)[node >= 0]
        nodes, offset = self.starts[walkers], np.zeros(len(walkers), np.int64)
        nodes[heads], offset[heads] = node[node >= 0], step[node >= 0] + 1
        seeds = mixed(self.seeds[self.doc_of_unit[walkers]] + np.full(1, r, np.uint64) * GOLDEN)
        sizes, walked = walk(self.at, nodes, mixed(seeds + self.unit_no[walkers].astype(np.uint64) * GOLDEN))
        fresh = np.bincount(np.repeat(np.arange(len(docs)), units), sizes, len(docs)).astype(np.int64)
        kept = np.array([i - first for _, first, i in before], np.int64)
        begins = np.cumsum(kept + 1 + fresh) - (kept + 1 + fresh)
        to_kept, at_branch = np.repeat(begins, kept) + within(kept), begins + kept
        to_fresh = np.repeat(at_branch + 1, fresh) + within(fresh)

        def laid(name: str, other: np.ndarray, rest: np.ndarray) -> np.ndarray:
            out = np.empty(len(to_kept) + len(docs) + len(to_fresh), np.int64)
            out[to_kept] = np.concatenate([x[name][first:i] for x, first, i in before])
            out[at_branch], out[to_fresh] = other, rest
            return out

        self.opened(
            docs, laid("unit", unit, np.repeat(walkers, sizes)), laid("step", step, within(sizes) + np.repeat(offset, sizes)), laid("edge", np.array(alternative), walked), value[docs], branch
        )

    def run(self, k: int) -> np.ndarray:
        """Opens k paths of each text (fewer where it has fewer) and gives the threshold: the next waiting value."""
        self.excluded_at: set[tuple[int, int, int]] = set()
        self.begin()
        for _ in range(k - 1):
            self.next()
        return self.best()[0]


def sampled_segmentations(docs: DataFrame, k: int = 2, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, alpha: float = ALPHA, seed: int = 0) -> DataFrame:
    """id, sample (1 to k), ids (array of int), log_prob, perturbed, inclusion: k different segmentations of each text.

    Segmentations are drawn without replacement from their distribution, in which the weight of a segmentation is the product
    of exp(alpha * score) of its pieces. inclusion is the probability that the sample holds this segmentation, given the
    threshold (1 where a text has no more than k). Draws depend on the seed, the id and the text's own lattice, so a row gives
    the same samples in whatever batch it comes. A text with fewer segmentations than k gives them all.

    Null and empty texts have one segmentation without pieces. A character without a piece becomes its UTF-8 bytes. Rows that
    repeat give repeated rows; extra columns are ignored. Row-wise, without a shuffle; texts are searched AT_ONCE bytes at a time, and lattices of their words kept up to KEPT_BYTES.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, lattices = pieces(model, alpha), lattices_of(model, alpha)
        for batch in slices(batches, "text", AT_ONCE):
            units, at, counts = units_of(pc.fill_null(batch.column("text"), ""))
            none = np.flatnonzero(counts == 0)
            rows, number, lp, perturbed = [none], [np.ones(len(none), np.int32)], [np.zeros(len(none))], [np.zeros(len(none))]
            inclusion, ids, sizes = [np.ones(len(none))], [np.zeros(0, np.int32)], [np.zeros(len(none), np.int64)]
            if len(at):
                search = Search(lattices, lattices.starts(units)[at], counts, mixed(batch.column("seed").to_numpy().astype(np.uint64)))
                threshold = search.run(k)
                for n, x in enumerate(search.rounds, 1):
                    own, bounds = plain(lattices.piece[x["edge"]], x["first"], vocabulary)
                    rows.append(x["docs"])
                    number.append(np.full(len(x["docs"]), n, np.int32))
                    lp.append(x["log_prob"])
                    perturbed.append(x["perturbed"])
                    inclusion.append(-np.expm1(-np.exp(np.minimum(x["log_prob"] - threshold[x["docs"]], 700.0))))
                    ids.append(own)
                    sizes.append(np.diff(bounds))
            rows, number = np.concatenate(rows), np.concatenate(number)
            order = pa.array(np.lexsort((number, rows)))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)), pa.array(np.concatenate(ids)))
            columns = [batch.column("id").take(pa.array(rows)), pa.array(number), lists, *(pa.array(np.concatenate(c)) for c in (lp, perturbed, inclusion))]
            yield pa.RecordBatch.from_arrays([c.take(order) for c in columns], ["id", "sample", "ids", "log_prob", "perturbed", "inclusion"])

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.lit(seed)).alias("seed"))
    return source.mapInArrow(run, f"id {kind}, sample int, ids array<int>, log_prob double, perturbed double, inclusion double").withColumnRenamed("id", id_col)


def plain(ids: np.ndarray, bounds: np.ndarray, vocabulary: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids with each character that has no piece as the ids of its bytes, and the bounds that follow from it."""
    alone = np.flatnonzero(ids >= vocabulary.size)
    if not len(alone):
        return ids.astype(np.int32), bounds
    parts = [[vocabulary.byte_ids[b] for b in chr(x).encode()] for x in (ids[alone] - vocabulary.size).tolist()]
    sizes = np.ones(len(ids), np.int64)
    sizes[alone] = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes)
    out = np.repeat(ids, sizes).astype(np.int32)
    out[np.repeat(ids >= vocabulary.size, sizes)] = [b for p in parts for b in p]
    return out, np.concatenate([[0], ends])[bounds]


def decoded(samples: DataFrame, ids_col: str = "ids", out_col: str = "decoded", model: str | None = None, keep: tuple[str, ...] = ("doc_id", "sample", "log_prob", "inclusion")) -> DataFrame:
    """The columns in keep, n_pieces, ids_crc32 (of the ids as little-endian 32-bit numbers) and out_col, the text that the ids stand for, as UTF-8 (binary). Null ids give nulls; an id outside the vocabulary stops the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = spellings(model)
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(ids_col)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            total, start = np.cumsum(sizes), 0
            while start < len(sizes):
                stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + DECODED_AT_ONCE, "right")))
                part = batch.slice(start, stop - start)
                column = part.column(ids_col)
                missing = column.is_null().to_numpy(zero_copy_only=False)
                ids, bounds = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes[start:stop])])
                data, at = vocabulary.decode(ids, bounds)
                raw = ids.astype("<u4")
                crcs = [zlib.crc32(raw[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
                texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())
                columns = [pa.array(np.diff(bounds), mask=missing), pa.array(np.array(crcs, np.int64), mask=missing), pc.if_else(pa.array(missing), pa.scalar(None, pa.binary()), texts)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *columns], [*keep, "n_pieces", "ids_crc32", out_col])
                start = stop

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in samples.select(*keep).schema]
    return samples.select(*keep, ids_col).mapInArrow(run, ", ".join([*fields, "n_pieces long", "ids_crc32 long", f"`{out_col}` binary"]))
