"""SentencePiece segmentations: k distinct samples a text by Gumbel top-k, and decoding.

Every text has a lattice of pieces; a path's probability is proportional to the product of its pieces' weights. Of a
model with log probabilities these are the weights; of a BPE model, whose scores are merge ranks, a piece weighs
(1 + rank) ** -alpha. Bytes stand in for a character only if no piece is that character.

Sampling without replacement adds a Gumbel to each path's log probability and takes the k largest sums, without listing
paths: the maximum over a subtree is a Gumbel shifted by the subtree's log probability. The search keeps subtrees by
their perturbed bounds, best first, and descends from the best one, a descent being a plain sample of the rest of the
text. No piece spans the start of a word, so a text's lattice is a chain of word lattices, and what a descent passes by
is kept as one subtree a word: the paths that are the same before the word and differ in it. Their probability is known
from the word alone, and their bound is a Gumbel truncated at that of the descent. Only when such a subtree is the best
is it split, by the edge at which its paths leave the word's: the edge that attains the bound is drawn by its share, the
others get truncated bounds of their own. The inclusion score of a sample is the probability to be above the bound that
the search stopped at, 1 - exp(-exp(log_prob - bound)); 1 if no path is left.

The descents of a batch of texts are made together, array by array, and so are the lattices of the words that are new in
it: pieces are found by walking a trie from all their places at once. A process remembers the lattices of the words it has
met, up to a bound, beyond which those met once are forgotten. Random numbers are hashes of the row's key, the round, the word and
the step, hence independent of batches and partitions.

Cases: null or empty texts have one path of no pieces; a text with fewer than k paths gets them all; rows of equal key
and text get equal samples; a null key counts as the empty one; very long texts are searched whole; ties in the bounds
are broken by place; an empty table gives no rows; other columns are ignored, but those to carry are returned as they are.
"""

from __future__ import annotations

import math
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.llm.common import kept_in_process

SAMPLES = 2
#: Texts, and characters, whose descents are made together.
ROWS, CHARS = 2048, 300_000
#: Edges of words' lattices that a process remembers, about.
EDGES = 3_000_000
#: Shares of edges are counted in units of 2 ** -UNITS.
UNITS = 46
#: Weights and shares below this are added as logarithms.
LEAST = 1e-250
#: The table of a trie's steps has 2 ** SLOTS slots.
SLOTS = 20


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def _mixed(key: np.ndarray, *more) -> np.ndarray:
    """Hashes of keys and numbers."""
    for m in more:
        key = _stir(key * np.uint64(0x9E3779B97F4A7C15) + np.asarray(m).astype(np.uint64) + np.uint64(1))
    return key


def _uniform(key: np.ndarray, *more) -> np.ndarray:
    """Numbers between 0 and 1, exclusive, that depend on all arguments."""
    return ((_mixed(key, *more) >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


def _slot(key: np.ndarray) -> np.ndarray:
    return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOTS)).view(np.int64)


def _longer(array: np.ndarray, n: int, more: np.ndarray) -> np.ndarray:
    """The first n values of an array and more after them, with room for others."""
    if n + len(more) > len(array):
        array = np.concatenate((array[:n], np.empty(max(len(more), n // 2), array.dtype)))
    array[n : n + len(more)] = more
    return array


def _ranges(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers first[i], first[i] + 1, ... of size[i] each, one after the other, and the i of each."""
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(len(of)) - (np.cumsum(size) - size)[of] + first[of], of


class _Numbers(dict):
    """Words by number, in the order in which they are asked for, and those that are new."""

    def __init__(self, words):
        super().__init__(words)
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = out = len(self)
        self.new.append(word)
        return out


class Lattices:
    """The pieces of a model as a trie in flat arrays, with the log weight of each."""

    def __init__(self, path: str, alpha: float = 1.0):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        own = [i for i in range(n) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) or self.model.is_unused(i))]
        score = {i: self.model.get_score(i) for i in own}
        ranks = min(score.values()) <= -1000
        self.vocabulary = {self.model.id_to_piece(i): (i, -alpha * math.log(1 - s) if ranks else alpha * s) for i, s in score.items()}
        self.bytes = {b: self.model.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
        self.byte_weight = -alpha * math.log(1 + n) if ranks else alpha * (min(score.values()) - 10)
        #: What the model puts before a text and takes away again.
        self.prefix = len(self.model.normalize("a")) - 1
        # Characters without a piece that holds them are words of their own.
        held = "".join(sorted({c for p in self.vocabulary for c in p} - {"▁"}))
        self.words = re.compile("▁*[" + re.escape(held) + "]+|▁+|.", re.S)
        # Where words don't end at ▁ and line ends alone.
        self.odd = re.compile("[^▁" + re.escape(held) + ("" if "\n" in held else "\n") + "]")
        self.line_end = "\n" if "\n" in held else " \n "
        #: What each id stands for, in UTF-8.
        spelt = [self.model.id_to_piece(i) for i in range(n)]
        self.spelt = pa.array([bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else x.replace("▁", " ").encode("utf-8", "replace") for i, x in enumerate(spelt)], pa.binary())
        # Trie nodes are numbered from 1; a step is a node and a character.
        nodes, steps = {"": 0}, {}
        for piece in self.vocabulary:
            for i in range(len(piece)):
                if piece[: i + 1] not in nodes:
                    nodes[piece[: i + 1]] = len(nodes)
                    steps[nodes[piece[:i]] << 21 | ord(piece[i])] = nodes[piece[: i + 1]]
        self.step = np.array(sorted(steps), np.int64)
        self.to = np.array([steps[x] for x in self.step.tolist()], np.int64)
        self.piece, self.weight = np.full(len(nodes), -1), np.zeros(len(nodes))
        for piece, (i, w) in self.vocabulary.items():
            self.piece[nodes[piece]], self.weight[nodes[piece]] = i, w
        self.inner = np.zeros(len(nodes), bool)
        self.inner[self.step >> 21] = True
        # First steps, which all places take, are in a table by character.
        self.root = np.zeros(0x110000, np.int32)
        first = self.step < 1 << 21
        self.root[self.step[first]] = self.to[first]
        # One step of each slot is in a table; slots with several are searched.
        slot = _slot(self.step)
        self.table, self.crowded = np.zeros(1 << SLOTS, np.int32), np.bincount(slot, minlength=1 << SLOTS) > 1
        self.table[slot] = np.arange(len(self.step))
        self.seen, self.length, self.node = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.degree, self.edge = np.zeros(0, np.int32), np.zeros(1, np.int64)
        #: Where an edge leads within its word, its piece, the log of its share among its node's, and the shares before it.
        self.target, self.of, self.log, self.low = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0), np.zeros(0, np.int64)
        self._restart([])

    def _restart(self, words: list[str]) -> None:
        """Remember these words only; their lattices are to be set."""
        self.number = _Numbers(zip(words, range(len(words)), strict=True))
        self.sizes = [0, 0, 0]

    def _forget(self) -> None:
        """Keep the words that were seen more than once; none if these are many."""
        kept = np.flatnonzero(self.seen[: self.sizes[0]] > 1)
        nodes, _ = _ranges(self.node[kept], self.length[kept])
        edges, _ = _ranges(self.edge[nodes], self.degree[nodes])
        if 2 * len(edges) > EDGES:
            return self._restart([])
        names = list(self.number)
        length, degree, others = self.length[kept], self.degree[nodes], [x[edges] for x in (self.target, self.of, self.log, self.low)]
        self._restart([names[i] for i in kept.tolist()])
        self._put(length, degree, others)

    def _put(self, length: np.ndarray, degree: np.ndarray, others: list[np.ndarray]) -> None:
        w, n, e = self.sizes
        self.seen = _longer(self.seen, w, np.zeros(len(length), np.int64))
        self.length, self.node = _longer(self.length, w, length), _longer(self.node, w + 1, n + np.cumsum(length))
        self.degree, self.edge = _longer(self.degree, n, degree), _longer(self.edge, n + 1, e + np.cumsum(degree))
        self.target, self.of, self.log, self.low = (_longer(x, e, more) for x, more in zip((self.target, self.of, self.log, self.low), others, strict=True))
        self.sizes = [w + len(length), n + len(degree), e + len(others[0])]

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of texts' words, and how many each text has. Lattices are made of words that aren't remembered.

        Numbers hold until the next call.
        """
        if self.sizes[2] > EDGES:
            self._forget()
        found = None if any("▁▁" in t or " " in t for t in texts) else self._cut(texts)
        if found is None:
            words = [self.words.findall(t) for t in texts]
            found = np.fromiter(map(self.number.__getitem__, chain.from_iterable(words)), np.int64), np.array([len(own) for own in words], np.int64)
        if self.number.new:
            self._make(self.number.new)
            self.number.new = []
        self.seen[: self.sizes[0]] += np.bincount(found[0], minlength=self.sizes[0])
        return found

    def _cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """numbers() of texts without runs of ▁, cut at ▁ and line ends; None if there are odd characters among them."""
        cut = pc.split_pattern(pc.replace_substring(pc.replace_substring(pa.array(texts, pa.string()), "▁", " ▁"), "\n", self.line_end), " ")
        flat = cut.flatten().dictionary_encode()
        words = flat.dictionary.to_numpy(zero_copy_only=False).tolist()
        number = list(map(self.number.get, words))
        new = [i for i, x in enumerate(number) if x is None]
        if self.odd.search("".join([words[i] for i in new])):
            return None
        for i in new:
            number[i] = self.number[words[i]] if words[i] else -1
        number = np.array(number, np.int64)[flat.indices.to_numpy()]
        row = np.repeat(np.arange(len(texts)), pc.list_value_length(cut).to_numpy())
        some = number >= 0
        return number[some], np.bincount(row[some], minlength=len(texts))

    def _make(self, words: list[str]) -> None:
        length = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(length)
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        end, n = np.repeat(ends, length), len(chars)
        source, to, piece, weight = self.edges(chars, end)
        degree = np.bincount(source, minlength=n)
        edge = np.cumsum(degree) - degree
        # Log weights of what follows a node, for all nodes at one distance from the ends of their words at a time.
        after = np.zeros(n + 1)
        target = np.where(to == end[source], n, to)
        left = end - np.arange(n)
        nodes = np.argsort(left, kind="stable")
        at, _ = _ranges(edge[nodes], degree[nodes])
        cuts = np.searchsorted(left[nodes], np.arange(1, left.max(initial=0) + 2))
        starts = np.concatenate(([0], np.cumsum(degree[nodes]))).astype(np.int64)
        weights, targets = weight[at], target[at]
        spans = [(lo, hi, starts[lo], starts[hi]) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True) if hi > lo]
        plain, total = np.exp(weights), np.ones(n + 1)
        for lo, hi, e, f in spans:
            total[nodes[lo:hi]] = np.add.reduceat(plain[e:f] * total[targets[e:f]], starts[lo:hi] - e)
        if LEAST < total.min() and total.max() < 1 / LEAST:
            after = np.log(total)
        else:
            # Long words, whose weights only logarithms hold.
            for lo, hi, e, f in spans:
                after[nodes[lo:hi]] = np.logaddexp.reduceat(weights[e:f] + after[targets[e:f]], starts[lo:hi] - e)
        log = np.minimum(weight + after[target] - after[source], 0.0)
        # Whole units, so that sums are exact whatever stands before.
        share = (np.exp(log) * 2.0**UNITS).astype(np.int64)
        before = np.cumsum(share) - share
        self._put(length, degree, [to - (end - np.repeat(length, length))[source], piece, log, before - before[edge[source]]])

    def _next(self, key: np.ndarray) -> np.ndarray:
        """Where steps lead, 0 for those that there aren't."""
        at = _slot(key)
        i = self.table[at]
        out = np.where(self.step[i] == key, self.to[i], 0)
        shared = np.flatnonzero(self.crowded[at])
        if len(shared):
            i = np.minimum(np.searchsorted(self.step, key[shared]), len(self.step) - 1)
            out[shared] = np.where(self.step[i] == key[shared], self.to[i], 0)
        return out

    def edges(self, chars: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(from, to, piece, log weight) of the edges over words side by side; end: where the word of each place ends.

        A piece of -1 - c stands for the bytes of character c.
        """
        # How many edges each place has so far.
        had = np.zeros(len(chars), np.int64)
        place, node, depth, out = np.arange(len(chars)), self.root[chars].astype(np.int64), 0, []
        while len(place):
            if depth:
                to = self._next(node << 21 | chars[place + depth])
                found = to > 0
            else:
                found, to = node > 0, node
            place, node, depth = place[found], to[found], depth + 1
            hit = self.piece[node] >= 0
            if depth == 1:
                odd = np.ones(len(chars), bool)
                odd[place[hit]] = False
            at = place[hit]
            out.append((at, had[at], np.full(len(at), depth), self.piece[node[hit]], self.weight[node[hit]]))
            had[at] += 1
            on = self.inner[node] & (place + depth < end[place])
            place, node = place[on], node[on]
        odd = np.flatnonzero(odd) if len(chars) else place
        c = chars[odd]
        size = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF) - 2 * (c == 0x2581)
        out.append((odd, had[odd], np.ones(len(odd), np.int64), -1 - c, self.byte_weight * size))
        had[odd] += 1
        source, nth, length, piece, weight = (np.concatenate(x) for x in zip(*out, strict=True))
        to = (np.cumsum(had) - had)[source] + nth
        order = np.empty(len(to), np.int64)
        order[to] = np.arange(len(to))
        return source[order], source[order] + length[order], piece[order], weight[order]


class _Batch:
    """Some texts as numbers of words, and the words' lattices in flat arrays: their characters as nodes, and the nodes' edges."""

    def __init__(self, lattices: Lattices, texts: list[str], keys: np.ndarray):
        self.word, sizes = lattices.numbers(texts)
        self.first = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        self.keys, self.bytes = keys, lattices.bytes
        self.length, self.node, self.degree, self.edge = lattices.length, lattices.node, lattices.degree, lattices.edge[: lattices.sizes[1] + 1]
        self.piece, self.to, self.log, self.low = lattices.of, lattices.target, lattices.log, lattices.low

    def descend(self, row: np.ndarray, at: np.ndarray, place: np.ndarray, turn: int):
        """Plain samples from the given places on: for each of them in order (request, word, node, edge) of each step."""
        size = self.first[row + 1] - at
        word, req = _ranges(at, size)
        pos = np.zeros(len(req), np.int64)
        heads = (np.cumsum(size) - size)[size > 0]
        pos[heads] = place[size > 0]
        steps = np.zeros(len(req), np.int64)
        kind, key = self.word[word], _mixed(self.keys[row][req], turn, word - self.first[row][req])
        live, out, step = np.flatnonzero(pos < self.length[kind]), [], 0
        while len(live):
            k = kind[live]
            node = self.node[k] + pos[live]
            # From the last edge of a node, mostly the likeliest, down to the one that the number falls in.
            e = self.edge[node + 1] - 1
            more = np.flatnonzero(self.degree[node] > 1)
            u = (_mixed(key[live[more]], step) >> np.uint64(64 - UNITS)).view(np.int64)
            while len(more):
                on = u < self.low[e[more]]
                more, u = more[on], u[on]
                e[more] -= 1
            out.append((live, step, node, e))
            steps[live] += 1
            pos[live] = self.to[e]
            live = live[pos[live] < self.length[k]]
            step += 1
        if not out:
            return tuple(np.empty(0, np.int64) for _ in range(4))
        # One edge of each step that a word takes, in order.
        first, total = np.cumsum(steps) - steps, int(steps.sum())
        nodes, edges = np.empty(total, np.int64), np.empty(total, np.int64)
        for live, step, node, e in out:
            at = first[live] + step
            nodes[at], edges[at] = node, e
        return np.repeat(req, steps), np.repeat(word, steps), nodes, edges

    def apart(self, node: np.ndarray, edge: np.ndarray, before: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Log probability of the paths that differ from descents in each of their words, which begin there."""
        if not len(begin):
            return np.empty(0)
        many = self.degree[node] > 1
        share = np.where(many, -np.expm1(self.log[edge]), 0.0)
        head = before[begin]
        out = np.add.reduceat(np.exp(before - np.repeat(head, np.diff(begin, append=len(node)))) * share, begin)
        with np.errstate(divide="ignore"):
            phi = head + np.log(out)
        # Where next to nothing is left, logarithms are added up.
        rare = np.flatnonzero((out < 1e-6) & np.logical_or.reduceat(many, begin))
        if len(rare):
            size = np.diff(begin, append=len(node))[rare]
            at, _ = _ranges(begin[rare], size)
            phi[rare] = np.logaddexp.reduceat(before[at] + self.others(node[at], edge[at]), np.cumsum(size) - size)
        return phi

    def others(self, node: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """Log of the share of each node's edges but the given one."""
        out = np.full(len(node), -np.inf)
        many = np.flatnonzero(self.degree[node] > 1)
        with np.errstate(divide="ignore"):
            out[many] = np.log(-np.expm1(self.log[edge[many]]))
        # Where next to nothing is left, it is added up.
        rare = many[self.log[edge[many]] > -1e-9]
        if len(rare):
            e, of = _ranges(self.edge[node[rare]], self.degree[node[rare]])
            log = np.where(e == edge[rare][of], -np.inf, self.log[e])
            out[rare] = np.logaddexp.reduceat(log, np.flatnonzero(np.diff(of, prepend=-1)))
        return out

    def split(self, turn: int, row: np.ndarray, bound: np.ndarray, before: np.ndarray, word: np.ndarray, own: list[np.ndarray]):
        """The subtrees of the paths that differ in a word from its edges own, of some requests together.

        (request, log probability, bound, number of own edges kept, edge) of each, those that attain the bounds, and the
        first of each request.
        """
        size = np.array([len(x) for x in own])
        edges, of = np.concatenate(own), np.repeat(np.arange(len(own)), size)
        node = np.searchsorted(self.edge, edges, "right") - 1
        run = np.concatenate(([0.0], np.cumsum(self.log[edges])))
        starts = np.cumsum(size) - size
        e, at = _ranges(self.edge[node], self.degree[node])
        other = e != edges[at]
        e, at = e[other], at[other]
        req = of[at]
        phi = before[req] + run[at] - run[starts[req]] + self.log[e]
        first = np.searchsorted(req, np.arange(len(own)))
        key = _mixed(self.keys[row], turn, word - self.first[row])
        # The one that attains the bound, by its share.
        share = np.exp(phi - np.maximum.reduceat(phi, first)[req])
        total = np.cumsum(share) - share
        low = total - total[first][req]
        u = _uniform(key, 78) * np.add.reduceat(share, first)
        drawn = np.maximum.reduceat(np.where(low <= u[req], np.arange(len(e)), 0), first)
        value = _truncated(phi, bound[req], _uniform(key[req], np.arange(len(e)) - first[req], 79))
        value[drawn] = bound
        return req, phi, value, at - starts[req], e, drawn, np.append(first, len(e))

    def ids(self, paths: list[np.ndarray]) -> list[np.ndarray]:
        """The ids of paths' pieces, with bytes spelt out."""
        own = self.piece[np.concatenate([np.empty(0, np.int64), *paths])]
        ends = np.cumsum([len(x) for x in paths])
        odd = own < 0
        if odd.any():
            kinds, at = np.unique(own[odd], return_inverse=True)
            spelt = [(" " if x == -1 - 0x2581 else chr(-1 - x)).encode("utf-8", "replace") for x in kinds.tolist()]
            size = np.array([len(x) for x in spelt])
            where, _ = _ranges((np.cumsum(size) - size)[at], size[at])
            width = np.ones(len(own), np.int64)
            width[odd] = size[at]
            ends = np.concatenate(([0], np.cumsum(width)))[ends]
            own, odd = np.repeat(own, width), np.repeat(odd, width)
            own[odd] = np.array([self.bytes[c] for x in spelt for c in x])[where]
        return np.split(own.astype(np.int32), ends[:-1])


def _truncated(phi: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbels of location phi that are at most bound."""
    return phi - np.log(np.exp(np.minimum(phi - bound, 700)) - np.log(u))


def sample(lattices: Lattices, texts: list[str], keys: list[int], k: int = SAMPLES) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each normalised text up to k distinct segmentations: (ids, log probability, perturbed log probability, inclusion score)."""
    rows = len(texts)
    b = _Batch(lattices, texts, np.array(keys, np.uint64))
    gumbel = -np.log(-np.log(_uniform(b.keys, 0, 0)))
    nothing = np.empty(0, np.int64)
    # An open subtree: bound, log probability, edges so far, the word and place it goes on at, and the edges from there to
    # the word's end that its paths must not all have (None: none), the log probability being that before these.
    heaps: list[list] = [[(float(gumbel[r]), 0.0, nothing, int(b.first[r]), 0, None)] for r in range(rows)]
    out: list[list] = [[] for _ in range(rows)]
    for turn in range(1, k + 1):
        row = np.array([r for r in range(rows) if heaps[r]], np.int64)
        if not len(row):
            break
        best = []
        for r in row.tolist():
            best.append(heaps[r].pop(max(range(len(heaps[r])), key=lambda i: heaps[r][i][0])))
        need = k - turn + 1
        cut = [i for i, x in enumerate(best) if x[5] is not None]
        if cut:
            took = [best[i] for i in cut]
            _, phi, value, kept, e, drawn, first = b.split(turn, row[cut], np.array([x[0] for x in took]), np.array([x[1] for x in took]), np.array([x[3] for x in took]), [x[5] for x in took])
            for j, (_, _, path, word, _, own) in enumerate(took):
                value[drawn[j]] = np.inf
                lo, hi = first[j], first[j + 1]
                top = lo + np.argsort(-value[lo:hi])[: need + 1]
                value[drawn[j]] = took[j][0]
                after = [(float(value[t]), float(phi[t]), np.concatenate((path, own[: kept[t]], e[t : t + 1])), *((word, int(b.to[e[t]])) if b.to[e[t]] < b.length[b.word[word]] else (word + 1, 0)), None) for t in top.tolist()]
                best[cut[j]] = after[0]
                heaps[row[cut[j]]] += after[1:]
        bound, start = np.array([x[0] for x in best]), np.array([x[1] for x in best])
        req, word, node, edge = b.descend(row, np.array([x[3] for x in best], np.int64), np.array([x[4] for x in best], np.int64), turn)
        ends = np.searchsorted(req, np.arange(len(row) + 1))
        run = np.concatenate(([0.0], np.cumsum(b.log[edge])))
        before = run[:-1] - run[ends[:-1]][req] + start[req]
        # One subtree for each word passed: log probability and bound.
        begin = np.flatnonzero((np.diff(word, prepend=-1) != 0) | (np.diff(req, prepend=-1) != 0))
        phi = b.apart(node, edge, before, begin)
        some = phi > -np.inf
        begin, stop, phi = begin[some], np.append(begin, len(word))[1:][some], phi[some]
        of, at = req[begin], word[begin]
        value = _truncated(phi, bound[of], _uniform(b.keys[row[of]], turn, at - b.first[row[of]], 77))
        cut = np.searchsorted(of, np.arange(len(row) + 1))
        for i, r in enumerate(row.tolist()):
            prefix, lo, hi = best[i][2], cut[i], cut[i + 1]
            out[r].append((np.concatenate((prefix, edge[ends[i] : ends[i + 1]])), float(start[i] + run[ends[i + 1]] - run[ends[i]]), float(bound[i])))
            top = np.arange(lo, hi) if hi - lo <= need else lo + np.argpartition(-value[lo:hi], need - 1)[:need]
            for t in top.tolist():
                s = int(begin[t])
                heaps[r].append((float(value[t]), float(before[s]), np.concatenate((prefix, edge[ends[i] : s])), int(word[s]), 0, edge[s : stop[t]]))
    ids = iter(b.ids([path for own in out for path, _, _ in own]))
    limits = [max((x[0] for x in heap), default=-math.inf) for heap in heaps]
    chance = lambda lp, limit: 1.0 if limit == -math.inf else -math.expm1(-math.exp(min(lp - limit, 700)))
    return [[(next(ids), lp, g, chance(lp, limit)) for _, lp, g in own] for own, limit in zip(out, limits, strict=True)]


def _sampled(path: str, k: int, alpha: float, seed: int, carry: list[str]):
    def run(batches):
        lattices = kept_in_process(f"lattices {path} {alpha}", lambda: Lattices(path, alpha))
        model, width = lattices.model, pc.binary_length(lattices.spelt).to_numpy()
        for batch in batches:
            keys, texts = batch.column("key").to_pylist(), [model.normalize(t or "") for t in batch.column("text").to_pylist()]
            lo = 0
            while lo < len(texts):
                hi, chars = lo, 0
                while hi < len(texts) and hi - lo < ROWS and (hi == lo or chars + len(texts[hi]) <= CHARS):
                    chars += len(texts[hi])
                    hi += 1
                made = sample(lattices, texts[lo:hi], [xxhash.xxh64_intdigest(str(x), seed) for x in keys[lo:hi]], k)
                flat = [(i, n, *s) for i, own in enumerate(made, lo) for n, s in enumerate(own)]
                at = pa.array([f[0] for f in flat], pa.int64())
                ids = np.concatenate([*(f[2] for f in flat), np.empty(0, np.int32)]).astype(np.int32)
                offsets = np.concatenate(([0], np.cumsum([len(f[2]) for f in flat]))).astype(np.int32)
                # Decoded, all samples side by side.
                ends = np.concatenate(([0], np.cumsum(width[ids])))[offsets].tolist()
                said = lattices.spelt.take(pa.array(ids)).buffers()[2].to_pybytes() if len(ids) else b""
                want = [t.replace("▁", " ").encode("utf-8", "replace") for t in texts[lo:hi]]
                flat = [(*f, said[a:b] == want[f[0] - lo]) for f, a, b in zip(flat, ends[:-1], ends[1:], strict=True)]
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
                kinds = {1: pa.int32(), 3: pa.float64(), 4: pa.float64(), 5: pa.float64(), 6: pa.bool_()}
                sampled, log_prob, perturbed, inclusion, same = (pa.array([f[j] for f in flat], t) for j, t in kinds.items())
                yield pa.RecordBatch.from_arrays([batch.column("key").take(at), sampled, ids, log_prob, perturbed, inclusion, same] + [batch.column(c).take(at) for c in carry], names=["key", "sample", "ids", "log_prob", "perturbed", "inclusion", "round_trip", *carry])
                lo = hi
    return run


def sample_pieces(rows: DataFrame, model: str, key: Column, text: Column, k: int = SAMPLES, alpha: float = 1.0, seed: int = 9, carry: tuple[str, ...] = ()) -> DataFrame:
    """key (as a string), sample, ids, log_prob, perturbed and inclusion of up to k segmentations of each row's text.

    Also round_trip, whether the sample decodes to the normalised text, and the columns carry of rows, as they are.

    model: a SentencePiece model file, the same on all executors.
    """
    own = rows.select(F.coalesce(key.cast("string"), F.lit("")).alias("key"), text.cast("string").alias("text"), *carry)
    kinds = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in carry)
    return own.mapInArrow(_sampled(model, k, alpha, seed, list(carry)), "key string, sample int, ids array<int>, log_prob double, perturbed double, inclusion double, round_trip boolean" + kinds)


def decode(rows: DataFrame, model: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """rows with the text of ids_col."""
    @F.pandas_udf("string")
    def run(ids):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=model)
        return ids.map(lambda x: None if x is None else m.decode([int(i) for i in x]))

    return rows.withColumn(text_col, run(F.col(ids_col)))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two distinct segmentations of every document, as ids, with a check that they decode to the text."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = sample_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), F.col("doc_id"), F.col("text"), carry=("doc_id",))
    return made.select("doc_id", "sample", F.size("ids").alias("n_pieces"), "log_prob", "perturbed", "inclusion", "ids", "round_trip")
