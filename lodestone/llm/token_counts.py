"""Word-piece token counts by a linear longest-match automaton.

The vocabulary is a trie. For every node the automaton stores a failure link and the number of pieces that
are popped when it is followed, so that greedy longest-match-first splitting of a word needs one pass over
its characters and only adds numbers; no piece is built. A node's link leads to the place in the
trie of ``##`` pieces that holds what is left after its longest piece (and further pieces) are popped.

Words repeat, so a task keeps the counts of words in a bounded cache; the automaton runs once per cached word.
"""

from __future__ import annotations

import functools
import re
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release_memory

#: A run of letters, digits and underscores, or one other character that is not white space.
TOKEN = re.compile(r"\w+|[^\w\s]")
CACHE_WORDS = 400_000


class Automaton:
    """Greedy word-piece lengths. Pieces that start with ``##`` continue a word, others begin one."""

    def __init__(self, pieces: Iterable[str]):
        # node 0: word start, node 1: after a popped piece; link -1: no way on
        self.next: list[dict[str, int]] = [{}, {}]
        self.ends = [False, False]
        for piece in pieces:
            node, rest = (1, piece[2:]) if piece.startswith("##") and len(piece) > 2 else (0, piece)
            if not rest:
                continue
            for ch in rest:
                child = self.next[node].get(ch)
                if child is None:
                    child = self.next[node][ch] = len(self.next)
                    self.next.append({})
                    self.ends.append(False)
                node = child
            self.ends[node] = True
        n = len(self.next)
        self.link, self.popped = [-1] * n, [0] * n
        queue: deque[tuple[int, str, int]] = deque((v, ch, root) for root in (0, 1) for ch, v in self.next[root].items())
        while queue:
            v, ch, parent = queue.popleft()
            if self.ends[v]:
                self.link[v], self.popped[v] = 1, 1
            else:
                z, count = self.link[parent], self.popped[parent]
                while z != -1 and ch not in self.next[z]:
                    count += self.popped[z]
                    z = self.link[z]
                if z != -1:
                    self.link[v], self.popped[v] = self.next[z][ch], count
            queue.extend((w, c, v) for c, w in self.next[v].items())

    def count(self, word: str) -> int:
        """The number of pieces of one word; a word that cannot be split is one unknown piece."""
        u, total = 0, 0
        for ch in word:
            while (v := self.next[u].get(ch)) is None:
                if (link := self.link[u]) == -1:
                    return 1
                total += self.popped[u]
                u = link
            u = v
        while u != 1:  # what is left must pop down to nothing
            if (link := self.link[u]) == -1:
                return 1
            total += self.popped[u]
            u = link
        return total


def greedy_count(word: str, vocab: set[str]) -> int:
    """The plain definition: cut the longest piece off the front, again and again."""
    at = total = 0
    while at < len(word):
        for end in range(len(word), at, -1):
            if ("##" if at else "") + word[at:end] in vocab:
                break
        else:
            return 1
        at, total = end, total + 1
    return total


@functools.cache
def pieces_of(model_path: str) -> tuple[str, ...]:
    """A SentencePiece vocabulary as word pieces: what begins with the word mark begins a word."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    out = []
    for k in range(sp.get_piece_size()):
        if sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k):
            continue
        piece = sp.id_to_piece(k)
        out.append(piece[1:] if piece.startswith("▁") else f"##{piece}")
    return tuple(p for p in out if p not in ("", "##"))


@functools.cache
def _automaton(pieces: tuple[str, ...]) -> Automaton:
    return Automaton(pieces)


class _Counts(dict):
    """word -> pieces, filled on demand."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = out = self.automaton.count(word)
        return out


def token_counts(docs: DataFrame, vocab_path: str | None = None, pieces: tuple[str, ...] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens of every row's whole text. Give the vocabulary's path or its pieces.

    Defined cases: a null, empty or blank text has 0 words and 0 tokens; a word with a character outside the
    vocabulary is one unknown token; a null id is carried along; repeated rows repeat; other columns are ignored.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(_automaton(pieces if pieces is not None else pieces_of(vocab_path)))
        get = counts.__getitem__
        for batch in batches:
            words, tokens = [], []
            for text in batch.column(1).to_pylist():
                found = TOKEN.findall(text) if text else []
                words.append(len(found))
                tokens.append(sum(map(get, found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])
        del counts, get
        release_memory()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {id_type}, n_words long, n_tokens long")
