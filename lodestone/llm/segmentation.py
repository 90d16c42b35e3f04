"""SentencePiece encoding and decoding: distinct sampled segmentations by Gumbel top-k.

The lattice of a text has a node per character and an edge per vocabulary piece. A hypothesis is a path
from the start; its subtree is everything it can grow into, with total probability exp(phi). A perturbed A-star search keeps hypotheses ordered by
the perturbed log-probability G of the best member of their subtree: the root's G is a Gumbel variable, and the
children's are Gumbel variables conditioned on their maximum being the parent's G (Kool et al. 2019).
So the search pops complete segmentations in the order of G: the first k are a sample of k distinct ones without replacement.
With kappa, the (k+1)-th largest G, a segmentation's inclusion score is 1 - exp(-exp(phi - kappa)).

The lattice falls apart where no piece can cross: at word starts and between characters that no piece has side by side. The chunks' edges and their
conditional probabilities are computed for many chunks together, as arrays, and kept in a bounded table. A popped hypothesis is completed
by edges drawn with these probabilities, which does not depend on G; so completions are drawn for all words of many texts together, and the search
itself looks at the first edges of each. Siblings further on are one hypothesis, split when it is popped: the best G among them is a Gumbel variable as well.
The random numbers of a row come from its key alone.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Bytes of lattices that a worker keeps before it starts anew; the bound changes no result.
CACHE_BYTES = 128 << 20
#: Characters of texts that are segmented together, in whole texts.
RUN_CHARS = 1_000_000
#: A path's siblings are hypotheses of their own for so many edges, or until its probability has fallen by exp(-FAR); the bounds change no result.
NEAR, FAR = 24, 5.0
U = np.uint64
#: A lone surrogate, which no text can hold; it stands for a word mark that is itself in the text.
_LITERAL = "\udfff"


class Pieces:
    """A SentencePiece vocabulary with unigram log-probabilities.

    The model file's scores are merge ranks; rank r gets the Zipf weight -log(r + shift), and
    ``alpha`` flattens it (the smoothing parameter of subword sampling). Characters
    outside the vocabulary are spelled as byte pieces on one edge.
    """

    def __init__(self, model_path: str, shift: float = 10.0, byte_penalty: float = -12.0, alpha: float = 0.3):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.text: dict[int, str] = {}
        self.bytes: dict[int, int] = {}
        self.ids: dict[str, tuple[int, float]] = {}
        rank = 0
        for k in range(sp.get_piece_size()):
            if sp.is_byte(k):
                self.bytes[k] = int(sp.id_to_piece(k)[3:5], 16)
            elif not (sp.is_control(k) or sp.is_unknown(k)):
                piece = sp.id_to_piece(k)
                self.text[k] = piece
                rank += 1
                if MARK not in piece.lstrip(MARK):
                    self.ids[piece] = (k, -alpha * math.log(rank + shift))
        self.byte_id = {b: k for k, b in self.bytes.items()}
        self.longest = max(map(len, self.ids))
        self.byte_penalty = alpha * byte_penalty
        self.size = sp.get_piece_size()
        self._pairs()
        self.table = Table(self)
        self.spell: tuple | None = None

    def word(self, chunk: str) -> list:
        """Per position of a chunk its edges: (cumulative probability, log-probability, ids, end); in the table the longest come first."""
        return self._lattice(chunk)

    def nodes(self, marked: str, starts: np.ndarray) -> np.ndarray:
        """The first nodes of chunks in the table, with lattices for new ones; edges got before are void if the table had to be emptied."""
        if self.table.size > CACHE_BYTES:
            self.table.clear()
        point = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32)
        lead, which = _alike(point, starts)
        words = [marked[a:b] for a, b in zip(starts[lead].tolist(), starts[lead + 1].tolist(), strict=True)]
        known = self.table.words
        out = np.array([known.get(w, -1) for w in words], np.int32)
        late = np.flatnonzero(out < 0).tolist()
        if late:
            new = [words[k] for k in late]
            self.table.add(list(dict.fromkeys(new)))
            out[late] = [known[w] for w in new]
        return out[which]

    def spelled(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids with the bytes of characters outside the vocabulary, and the ends there."""
        foreign = np.flatnonzero(ids >= self.size)
        if not len(foreign):
            return ids, ends
        points, which = np.unique(ids[foreign] - self.size, return_inverse=True)
        raw = [chr(p).encode("utf-8", "surrogatepass") for p in points.tolist()]
        times = np.ones(len(ids), np.int64)
        times[foreign] = np.array([len(x) for x in raw])[which]
        to = np.concatenate(([0], np.cumsum(times)))
        out = np.repeat(ids, times)
        table = np.zeros((len(raw), 4), np.int32)
        for k, x in enumerate(raw):
            table[k, : len(x)] = [self.byte_id[b] for b in x]
        for k in range(4):
            here = times[foreign] > k
            out[to[foreign[here]] + k] = table[which[here], k]
        return out, to[ends]

    def round_trips(self, ids: np.ndarray, ends: np.ndarray, texts: list[str]) -> list[bool]:
        """Whether decoding ids[ends[k]:ends[k + 1]] gives text k."""
        if self.spell is None:
            raw = [bytes([self.bytes[k]]) if k in self.bytes else self.text.get(k, "").replace(MARK, " ").encode() for k in range(self.size)]
            length = np.array([len(x) for x in raw], np.int32)
            self.spell = np.frombuffer(b"".join(raw), np.uint8), length, np.cumsum(length, dtype=np.int32) - length
        letters, length, start = self.spell
        # the encoder's own word mark comes first; the empty text has no ids
        want = np.frombuffer("".join(" " + t if t else "" for t in texts).encode("utf-8", "surrogatepass"), np.uint8)
        n = length[ids]
        to = np.cumsum(n, dtype=np.int64)
        if len(to) and to[-1] == len(want) or not len(to) and not len(want):
            got = letters[np.repeat((start[ids] - (to - n)).astype(np.int32), n) + np.arange(len(want), dtype=np.int32)]
            if (got == want).all() and np.concatenate(([0], to))[ends].tolist() == np.cumsum([0, *(len(t.encode("utf-8", "surrogatepass")) + 1 if t else 0 for t in texts)]).tolist():
                return [True] * len(texts)
        return [self.decode(ids[a:b].tolist()) == t for a, b, t in zip(ends, ends[1:], texts, strict=False)]

    def _lattice(self, chunk: str) -> list:
        n = len(chunk)
        beta, out = [0.0] * (n + 1), [None] * n
        for i in range(n - 1, -1, -1):
            edges = []
            for j in range(i + 1, min(n, i + self.longest) + 1):
                hit = self.ids.get(chunk[i:j])
                if hit:
                    edges.append((hit[1] + beta[j], (hit[0],), j))
            if not any(j == i + 1 for _, _, j in edges):
                ch = MARK if chunk[i] == _LITERAL else chunk[i]
                ids = tuple(self.byte_id[b] for b in ch.encode("utf-8", "surrogatepass"))
                edges.append((self.byte_penalty * len(ids) + beta[i + 1], ids, i + 1))
            top = max(e[0] for e in edges)
            beta[i] = top + math.log(sum(math.exp(e[0] - top) for e in edges))
            total, here = 0.0, []
            for score, ids, j in edges:
                total += math.exp(score - beta[i])
                here.append((total, score - beta[i], ids, j))
            out[i] = here
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of a segmentation; the first word mark is the encoder's own."""
        out, raw = [], bytearray()
        for k in ids:
            if k in self.bytes:
                raw.append(self.bytes[k])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw = bytearray()
            out.append(self.text[k].replace(MARK, " "))
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out)[1:]

    def cut(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
        """The marked texts in a row, where chunks start in it (and its end), and the first chunk of each text (and their number). The cuts are where no piece can cross."""
        marked = "".join([MARK + t.replace(MARK, _LITERAL).replace(" ", MARK) for t in texts])
        near = self.pair_letter[np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32)]
        starts = np.ones(len(marked) + 1, bool)
        starts[1:-1] = ~self.pairs[near[:-1], near[1:]]
        first = np.cumsum([0, *(len(t) + 1 for t in texts)])
        starts[first] = True
        starts = np.flatnonzero(starts)
        return marked, starts, np.searchsorted(starts, first)

    def chunks(self, text: str) -> list[str]:
        """The chunks of one text."""
        marked, starts, _ = self.cut([text])
        return [marked[a:b] for a, b in zip(starts, starts[1:], strict=False)]

    def _pairs(self) -> None:
        """The pairs of characters that some piece has side by side; 0 stands for characters of no such pair. Runs of marks stay whole."""
        inner = {piece[k : k + 2] for piece in self.ids for k in range(len(piece) - 1)} | {MARK + MARK}
        letters = sorted({ch for pair in inner for ch in pair})
        self.pair_letter = np.zeros(0x110000, np.int32)
        self.pair_letter[[ord(ch) for ch in letters]] = np.arange(1, len(letters) + 1)
        self.pairs = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        self.pairs[tuple(self.pair_letter[[ord(pair[k]) for pair in inner]] for k in (0, 1))] = True


class Table:
    """The lattices of many words as arrays. Nodes have ``degree`` edges from ``base`` on, which know their ``source``.

    Edge e leads to node to[e] (-1: the word's end) with conditional log-probability log_q[e]; cum[e] is the sum of the probabilities up to it in its node,
    infinite for the last. id[e] is a piece, or the vocabulary's size plus a code point that is spelled in bytes.
    """

    _NODE, _EDGE = {"base": np.int32, "degree": np.int32}, {"to": np.int32, "source": np.int32, "id": np.int32, "cum": np.float64, "log_q": np.float64}

    def __init__(self, vocab: Pieces):
        self.byte_penalty, self.first_byte = vocab.byte_penalty, vocab.size
        # a trie of the pieces: child of (state, letter) in an open hash table; letters are numbered from 1
        letters = sorted({ch for piece in vocab.ids for ch in piece})
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[[ord(ch) for ch in letters]] = np.arange(1, len(letters) + 1)
        self.letters = len(letters) + 1
        number = {ch: k for k, ch in enumerate(letters, 1)}
        children: dict[int, int] = {}
        piece_of, score_of = [-1], [0.0]
        for piece, (k, score) in vocab.ids.items():
            state = 0
            for ch in piece:
                state = children.setdefault(state * self.letters + number[ch], len(piece_of))
                if state == len(piece_of):
                    piece_of.append(-1)
                    score_of.append(0.0)
            piece_of[state], score_of[state] = k, score
        self.piece_of, self.score_of = np.array(piece_of, np.int32), np.array(score_of)
        keys, child = np.fromiter(children.keys(), np.int64), np.fromiter(children.values(), np.int32)
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.child = np.full(1 << self.bits, -1), np.full(1 << self.bits, -1, np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] == -1]
            self.keys[at[free]] = keys[free]  # of several keys for one place one stays
            won = self.keys[at[left]] == keys[left]
            self.child[at[left[won]]] = child[left[won]]
            left = left[~won]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
        self.root = self._children(np.arange(self.letters)).astype(np.int64)
        for names in (self._NODE, self._EDGE):
            for name, kind in names.items():
                setattr(self, name, np.zeros(1024, kind))
        self.clear()

    def clear(self) -> None:
        self.words: dict[str, int] = {}
        self.used = [0, 0]

    @property
    def size(self) -> int:
        """Bytes in use, with about 200 for a word's name."""
        return 8 * self.used[0] + 28 * self.used[1] + 200 * len(self.words)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(U) * U(0x9E3779B97F4A7C15) >> U(64 - self.bits)).astype(np.int64)

    def _children(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.child[at], -1)
        left = np.flatnonzero((there != keys) & (there != -1))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            there = self.keys[at[left]]
            hit = there == keys[left]
            out[left[hit]] = self.child[at[left[hit]]]
            left = left[~hit & (there != -1)]
        return out

    def _append(self, which: int, names: dict, arrays: dict[str, np.ndarray]) -> None:
        have, n = self.used[which], len(next(iter(arrays.values())))
        for name in names:
            old = getattr(self, name)
            if len(old) < have + n:
                old = np.concatenate((old[:have], np.empty(have + 2 * n, old.dtype)))
                setattr(self, name, old)
            old[have : have + n] = arrays[name]
        self.used[which] += n

    def add(self, words: list[str]) -> None:
        """Lattices of new words. The nodes of all are ordered by their distance from the word's end, as probabilities come from there."""
        words.sort(key=len, reverse=True)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        point = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        letter = self.letter[point].astype(np.int64)
        total, longest = len(point), len(words[0])
        word = np.repeat(np.arange(len(words)), lengths)
        left = np.cumsum(lengths)[word] - np.arange(total)  # letters up to the word's end
        level = np.concatenate(([0, 0], np.cumsum(np.bincount(left, minlength=longest + 1)[1:])))  # nodes with r letters left: level[r] to level[r + 1]
        node = level[left] + word
        degree = np.zeros(total, np.int64)
        short = np.zeros(total, bool)
        found = []
        active, state, n = np.arange(total), None, 0
        while len(active):
            state = self._children(state * self.letters + letter[active + n]).astype(np.int64) if n else self.root[letter]
            alive = state >= 0
            active, state, n = active[alive], state[alive], n + 1
            ends = self.piece_of[state] >= 0
            here, piece = active[ends], state[ends]
            if n == 1:
                short[here] = True
            found.append((here, n, self.piece_of[piece], self.score_of[piece]))
            more = left[active] > n
            active, state = active[more], state[more]
        foreign = np.flatnonzero(~short)
        points = np.where(point[foreign] == ord(_LITERAL), ord(MARK), point[foreign])
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        found.append((foreign, 1, (points + self.first_byte).astype(np.int32), self.byte_penalty * width))
        slots = []
        for here, *_ in found:
            slots.append(degree[here])
            degree[here] += 1
        by_node = np.zeros(total, np.int64)
        by_node[node] = degree
        base = np.cumsum(by_node) - by_node
        count = int(by_node.sum())
        to, ids, score, beta = np.full(count, total), np.zeros(count, np.int32), np.zeros(count), np.zeros(total + 1)
        for (here, n, piece, weight), slot in zip(found, slots, strict=True):
            at = base[node[here]] + degree[here] - 1 - slot  # longest first, as these are the likeliest
            inside = left[here] > n
            to[at[inside]] = node[here[inside] + n]
            ids[at], score[at] = piece, weight
        q = np.zeros(count)
        bounds = np.append(base, count)
        for r in range(1, longest + 1):
            lo, hi = level[r], level[r + 1]
            a, b = bounds[lo], bounds[hi]
            score[a:b] += beta[to[a:b]]
            starts, many = base[lo:hi] - a, by_node[lo:hi]
            top = np.maximum.reduceat(score[a:b], starts)
            part = np.exp(score[a:b] - np.repeat(top, many))
            whole = np.add.reduceat(part, starts)
            beta[lo:hi] = top + np.log(whole)
            q[a:b] = part / np.repeat(whole, many)
        source = np.repeat(np.arange(total), by_node)
        rows = np.flatnonzero(by_node > 1)
        for k in range(1, int(by_node.max())):
            rows = rows[by_node[rows] > k]
            q[base[rows] + k] += q[base[rows] + k - 1]
        q[bounds[1:] - 1] = np.inf
        nodes, edges = self.used
        to = np.where(to < total, to + nodes, -1)
        self._append(0, self._NODE, {"base": base + edges, "degree": by_node})
        self._append(1, self._EDGE, {"to": to, "source": source + nodes, "id": ids, "cum": q, "log_q": score - beta[source]})
        self.words.update(zip(words, (level[lengths] + np.arange(len(words)) + nodes).tolist(), strict=True))

    def walk(self, node: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A random path from each node to its word's end: all edges, those of walk k at ends[k] to ends[k + 1]. The random numbers of a walk come from its key alone."""
        n = len(node)
        steps, length = [], np.zeros(n, np.int64)
        base, cum, to = self.base, self.cum, self.to
        who = np.arange(n, dtype=np.int32)
        while len(who):
            key = key + U(0x9E3779B97F4A7C15)
            u = (_mix(key) >> U(11)) * 2.0**-53
            edge = base[node]
            late = np.flatnonzero(u >= cum[edge])
            while len(late):
                edge[late] += 1
                late = late[u[late] >= cum[edge[late]]]
            steps.append((who, edge))
            node = to[edge]
            on = node >= 0
            length[who[~on]] = len(steps)
            who, node, key = who[on], node[on], key[on]
        ends = np.concatenate(([0], np.cumsum(length)))
        out = np.empty(int(ends[-1]), np.int32)
        for k, (who, edge) in enumerate(steps):
            out[ends[who] + k] = edge
        return out, ends


@functools.cache
def pieces(model_path: str) -> Pieces:
    return Pieces(model_path)


def _mix(x: np.ndarray) -> np.ndarray:
    y = x >> U(30)
    y ^= x
    y *= U(0xBF58476D1CE4E5B9)
    y ^= y >> U(27)
    y *= U(0x94D049BB133111EB)
    y ^= y >> U(31)
    return y


def _alike(point: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks that stand for all, and for each chunk which of them is equal to it: found by hashes, then compared; a clash of hashes stands for itself."""
    total = np.zeros(len(point) + 1, U)
    np.cumsum(_mix(point.astype(U) + U(1)) * _power(0, len(point)), out=total[1:])
    n = np.diff(starts)
    name = _mix((total[starts[1:]] - total[starts[:-1]]) * _power(1, len(point))[starts[:-1]] + n.astype(U))
    order = np.argsort(name, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = name[order[1:]] != name[order[:-1]]
    lead = order[new]
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    of = lead[which]
    same = n[of] == n
    shift = np.where(same, starts[:-1][of] - starts[:-1], 0)
    differs = point[np.arange(len(point)) + np.repeat(shift, n)] != point
    clash = np.flatnonzero(~same | np.logical_or.reduceat(differs, starts[:-1])) if not same.all() or differs.any() else []
    if len(clash):
        which[clash] = len(lead) + np.arange(len(clash))
        lead = np.concatenate((lead, clash))
    return lead, which


_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _power(which: int, n: int) -> np.ndarray:
    """The first n powers of an odd base modulo 2^64, or of its inverse."""
    if len(_powers[which]) < n:
        base = U(0x5851F42D4C957F2D if which == 0 else pow(0x5851F42D4C957F2D, -1, 1 << 64))
        _powers[which] = np.concatenate(([U(1)], np.cumprod(np.full(max(n, 1 << 20), base))))
    return _powers[which][:n]


class _Draws:
    """Drawn segmentations of some texts: how many per text, the ids of all with their ends, log-probabilities and logs of the inclusion scores."""

    def __init__(self):
        self.count, self.parts, self.lengths, self.log_prob, self.log_inclusion = [], [], [], [], []

    def add(self, found: list[tuple[list[np.ndarray], float]], kappa: float | None) -> None:
        self.count.append(len(found))
        for parts, phi in found:
            self.parts += parts
            self.lengths.append(sum(map(len, parts)))
            self.log_prob.append(phi)
            self.log_inclusion.append(0.0 if kappa is None else _log_inclusion(phi - kappa))

    def close(self, vocab: Pieces) -> None:
        edges = np.concatenate(self.parts) if self.parts else np.zeros(0, np.int32)
        self.ends = np.cumsum([0, *self.lengths])
        self.ids, self.ends = vocab.spelled(vocab.table.id[edges], self.ends)


def sample_texts(vocab: Pieces, texts: list[str], k: int, rngs: list[np.random.Generator]) -> _Draws:
    """Up to k distinct segmentations of each text in the order drawn.

    A hypothesis' completion is independent of every score, so for all words of all texts k completions are drawn together (``Table.walk``);
    the n-th completion that a text's search needs takes its words from the n-th of these.
    """
    marked, starts, at = vocab.cut([t for t in texts if t])
    full = np.array([bool(t) for t in texts], bool)
    n_words = np.zeros(len(texts), np.int64)
    n_words[full] = np.diff(at)
    first = np.concatenate(([0], np.cumsum(n_words))).tolist()
    start = vocab.nodes(marked, starts) if full.any() else np.zeros(0, np.int32)
    table = vocab.table
    place = np.arange(len(start), dtype=U) - np.repeat(np.array(first[:-1], U), n_words)
    seeds = np.array([rng.integers(0, 1 << 64, k, U) for rng in rngs], U).reshape(len(texts), k)
    fresh = []
    for d in range(k):
        edges, ends = table.walk(start, _mix(np.repeat(seeds[:, d], n_words) + place * U(0xD1342543DE82EF95)))
        fresh.append((edges, ends, table.log_q[edges]))
    out = _Draws()
    for r, rng in enumerate(rngs):
        if n_words[r]:
            out.add(*_search(table, fresh, first[r], first[r + 1], k, rng))
        else:
            out.add([([], 0.0)], None)
    out.close(vocab)
    return out


def _search(table: Table, fresh: list[tuple[np.ndarray, np.ndarray, np.ndarray]], lo: int, hi: int, k: int, rng: np.random.Generator) -> tuple[list[tuple[list[np.ndarray], float]], float | None]:
    """The perturbed A-star search over the words lo to hi: up to k paths (edges in parts, log-probability), and kappa unless no more are left.

    A path is what it shares with an earlier one, then its own edges: ``head`` (the edge where it leaves that one, and the rest of this word), then
    words as drawn. Its siblings are hypotheses of their own near its start; all those further on are one
    hypothesis until it is popped, as their total probability bounds the best G among them.
    """
    log, exp, log1p = math.log, math.exp, math.log1p
    pool: list[float] = []

    def uniform() -> float:
        if not pool:
            pool.extend(rng.random(128).tolist())
        return pool.pop() or 5e-324

    pending: list[tuple] = []  # by falling G: G, log-probability, path that it leaves, own edge there, sibling edge (-1: any from there on)
    paths: list[tuple] = []  # parts before, head, word of the head, first and last of the edges as drawn
    done = []
    g, phi, source, at, edge = -log(-log(uniform())), 0.0, -1, 0, 0

    def offer(g: float, x: float, p: float, room: int, source: int, at: int, edge: int) -> None:
        # a part of the subtree that G = g was the best of: its first arrival is an exponential time after
        d = log(x) - p
        if len(pending) >= room - 1 and -d <= pending[room - 2][0]:
            return
        if edge < 0:  # p was a bound
            p = _rest(table, fresh[source][0], paths[source], at, p)[2]
            if p is None:
                return
            d = log(x) - p
        m = -g if -g > d else d
        other = d if m == -g else -g
        gc = -(m + log1p(exp(other - m)))
        if len(pending) >= room - 1 and gc <= pending[room - 2][0]:
            return
        n = 0
        while n < len(pending) and pending[n][0] >= gc:
            n += 1
        pending.insert(n, (gc, p, source, at, edge))
        del pending[room - 1 :]

    while True:
        d = len(done)
        room = k + 1 - d
        edges, ends, logs = fresh[d]
        if source < 0:
            before, head, word = [], [], lo - 1
        else:
            old_before, old_head, old_word, old_a, _ = paths[source]
            old = fresh[source]
            if edge < 0:
                own, p, total = _rest(table, old[0], paths[source], at, 0.0)
                base_p = phi - total
                u = np.exp(p - p.max())
                u = np.cumsum(u)
                pick = min(int(np.searchsorted(u, rng.random() * u[-1], side="right")), len(u) - 1)
                d_all = np.log(np.maximum(rng.standard_exponential(len(p)), 5e-324)) - (p + base_p)
                for j in np.argsort(d_all, kind="stable")[: room + 1].tolist():
                    if j != pick:
                        offer(g, exp(d_all.item(j) + p.item(j) + base_p), p.item(j) + base_p, room, source, own[0].item(j), own[1].item(j))
                phi, at, edge = p.item(pick) + base_p, own[0].item(pick), own[1].item(pick)
            more = at - len(old_head)
            if more < 0:
                before, word = [*old_before, np.array(old_head[:at], np.int32)], old_word
            else:
                before = [*old_before, np.array(old_head, np.int32), old[0][old_a : old_a + more]]
                word = int(np.searchsorted(old[1], old_a + more, side="right")) - 1
            head = [edge]
            node = table.to.item(edge)
        p = phi
        if source >= 0:
            while node >= 0:
                b, m = table.base.item(node), table.degree.item(node)
                if m > 1:
                    u = uniform()
                    b += next(j for j, c in enumerate(table.cum[b : b + m].tolist()) if u < c)
                head.append(b)
                node = table.to.item(b)
        a, z = ends.item(word + 1), ends.item(hi)
        paths.append((before, head, word, a, z))
        done.append(([*before, np.array(head, np.int32), edges[a:z]], phi + sum(table.log_q.item(e) for e in head[1:]) + float(logs[a:z].sum())))
        skip = 1 if head else 0
        near = head[skip:] + edges[a : min(z, a + NEAR)].tolist()
        n = 0
        for n, e in enumerate(near, skip):
            if p < phi - FAR:
                break
            node = table.source.item(e)
            m = table.degree.item(node)
            if m > 1:
                b = table.base.item(node)
                logs_here = table.log_q[b : b + m].tolist()
                for j, q in enumerate(logs_here, b):
                    if j != e:
                        x = -log(uniform()) or 5e-324
                        if len(pending) < room - 1 or p + q - log(x) > pending[room - 2][0]:
                            offer(g, x, p + q, room, d, n, j)
                p += logs_here[e - b]
        else:
            n = len(near) + skip
        if n < len(head) + z - a:
            offer(g, -log(uniform()) or 5e-324, p, room, d, n, -1)
        if len(done) == k or not pending:
            break
        g, phi, source, at, edge = pending.pop(0)
    return done, pending[0][0] if pending else None


def _rest(table: Table, edges: np.ndarray, path: tuple, at: int, p: float) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, float | None]:
    """The siblings of a path's own edges from ``at`` on (place, edge), their log-probabilities, and that of all (None: there are none); p is that of the path so far."""
    _, head, _, a, z = path
    own = np.concatenate((np.array(head[at:], np.int32), edges[a + max(0, at - len(head)) : z]))
    node = table.source[own]
    many = table.degree[node]
    sofar = p + np.concatenate(([0.0], np.cumsum(table.log_q[own])[:-1]))
    place = np.repeat(np.arange(len(own)), many)
    all_edges = table.base[node][place] + np.arange(len(place)) - (np.cumsum(many) - many)[place]
    other = all_edges != own[place]
    place, sibling = place[other], all_edges[other]
    logs = sofar[place] + table.log_q[sibling]
    if not len(logs):
        return (place, sibling), logs, None
    top = float(logs.max())
    return (place + at, sibling), logs, top + math.log(float(np.exp(logs - top).sum()))


def sample(vocab: Pieces, text: str, k: int, rng: np.random.Generator) -> list[tuple[list[int], float, float]]:
    """Up to k distinct segmentations in the order drawn: (ids, log-probability, log of the inclusion score).

    Fewer than k only if the text has fewer; then every inclusion score is 1. The empty text has one, without ids.
    """
    got = sample_texts(vocab, [text], k, [rng])
    return [(got.ids[a:b].tolist(), lp, inc) for a, b, lp, inc in zip(got.ends, got.ends[1:], got.log_prob, got.log_inclusion, strict=False)]


def _log_inclusion(x: float) -> float:
    """log(1 - exp(-exp(x))), which is x itself far down."""
    inside = -math.expm1(-math.exp(min(700.0, x)))
    return math.log(inside) if inside > 1e-300 else x


def row_rng(seed: int, *key) -> np.random.Generator:
    digest = hashlib.blake2b(repr((seed, *key)).encode("utf-8", "surrogatepass"), digest_size=16).digest()
    return np.random.Generator(np.random.PCG64(int.from_bytes(digest, "little")))


def sample_segmentations(rows: DataFrame, model_path: str, k: int = 3, seed: int = 0, key_cols: tuple[str, ...] = ("conv_id", "turn"), text_col: str = "text") -> DataFrame:
    """The key columns, draw (from 0), ids, log_prob, inclusion, log_inclusion (of long texts the score itself may be too small for a double) and round_trip (decoding gives the text).

    Defined cases: a null text counts as empty: one draw without ids, log-probability 0, inclusion 1; null keys are
    keys like others; rows with the same key and text get the same draws; a text with fewer than k segmentations
    gives them all; a literal word mark is spelled in bytes; other columns are ignored.
    """
    types = [rows.schema[c].dataType.simpleString() for c in key_cols]
    n_keys = len(key_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = pieces(model_path)
        for batch in batches:
            chars = np.cumsum([len(t or "") + 1 for t in batch.column(n_keys).to_pylist()])
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(chars, (chars[lo - 1] if lo else 0) + RUN_CHARS, side="right")))
                part, lo = batch.slice(lo, hi - lo), hi
                keys = [part.column(j).to_pylist() for j in range(n_keys)]
                texts = [t or "" for t in part.column(n_keys).to_pylist()]
                got = sample_texts(vocab, texts, k, [row_rng(seed, *(c[r] for c in keys)) for r in range(len(texts))])
                row = np.repeat(np.arange(len(texts)), got.count)
                draw = np.arange(len(row)) - np.repeat(np.cumsum(got.count) - got.count, got.count)
                trips = vocab.round_trips(got.ids, got.ends, [texts[r] for r in row.tolist()])
                ids = pa.ListArray.from_arrays(pa.array(got.ends, pa.int32()), pa.array(got.ids, pa.int32()))
                index = pa.array(row)
                cols = (pa.array(draw, pa.int32()), ids, pa.array(got.log_prob, pa.float64()), pa.array(got.log_inclusion, pa.float64()), pa.array(trips, pa.bool_()))
                yield pa.RecordBatch.from_arrays([*[part.column(j).take(index) for j in range(n_keys)], *cols], names=[*[f"k{j}" for j in range(n_keys)], "draw", "ids", "log_prob", "log_inclusion", "round_trip"])

    schema = ", ".join(f"k{j} {t}" for j, t in enumerate(types)) + ", draw int, ids array<int>, log_prob double, log_inclusion double, round_trip boolean"
    out = rows.select(*[F.col(c).alias(f"k{j}") for j, c in enumerate(key_cols)], F.col(text_col).alias("text")).mapInArrow(run, schema)
    return out.select(*[F.col(f"k{j}").alias(c) for j, c in enumerate(key_cols)], "draw", "ids", "log_prob", F.exp("log_inclusion").alias("inclusion"), "log_inclusion", "round_trip")


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids", key_cols: tuple[str, ...] = ("conv_id", "turn")) -> DataFrame:
    """The key columns and the decoded text; null ids give a null text, empty ids the empty text."""
    types = [rows.schema[c].dataType.simpleString() for c in key_cols]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = pieces(model_path)
        for batch in batches:
            texts = [None if ids is None else vocab.decode(ids) for ids in batch.column(len(key_cols)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(j) for j in range(len(key_cols))], pa.array(texts, pa.string())], names=[*[f"k{j}" for j in range(len(key_cols))], "text"])

    schema = ", ".join(f"k{j} {t}" for j, t in enumerate(types)) + ", text string"
    out = rows.select(*[F.col(c).alias(f"k{j}") for j, c in enumerate(key_cols)], F.col(ids_col).alias("ids")).mapInArrow(run, schema)
    return out.select(*[F.col(f"k{j}").alias(c) for j, c in enumerate(key_cols)], "text")
